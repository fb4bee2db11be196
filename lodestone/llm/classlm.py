"""LM scoring with Brown class-based bigrams.

Every word has one class; a text's probability is the product of class transitions and word emissions. The classes of
the frequent words (at least 1/HEAD of all tokens each, so at most HEAD of them) come from exchange clustering on their
bigram counts: each word in turn moves to the class that raises the likelihood most, with the class counts updated at
once; the neighbours' classes are renewed after each quarter of the words. Every other word of the corpus goes to the class
whose neighbours its own neighbours resemble most.

All counts cover the whole training text. Blocks of documents send their distinct words, packed by ranges of the
word's hash; a range's task sums counts and contexts, decides classes, and answers each block with the counts and classes of
its own words, so no task and not the driver ever holds the vocabulary. The driver holds the frequent words' context
vectors (HEAD rows at most) and the class matrices.

Smoothing: transitions are mixed with the classes' shares, emissions add half a count to each word and to one unknown
word for each class. Null or empty text: the end token alone. A null id is text "" for the fold, that is learned from.
Repeated rows are documents each. With nothing to learn from, all words are unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import make_blocks, opened, pack, unpack
from lodestone.llm.storage import materialize
from lodestone.llm.text import NULL_ID, Words

U64 = np.uint64
#: A word is frequent from this part of all tokens on; classes besides that of the end token; quarter sweeps; weight of shares.
HEAD, CLASSES, SWEEPS, SHARE_WEIGHT = 50_000, 32, 16, 10.0
QUARTERS = 4
#: Distinct words of blocks that a range's task is to hold.
RANGE = 500_000
END = U64(1)  # the hash that stands for the end token


def held_out(k_id: np.ndarray, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % folds == fold for i in k_id.tolist()], dtype=bool)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, and where each document's begin, with a closing total."""
    w = Words(texts, lower=True)
    first = w.first + np.arange(len(w) + 1)
    out = np.full(int(first[-1]), END, dtype=U64)
    h = w.hashes()
    out[np.arange(len(h)) + w.doc_of_word()] = np.where(h == END, U64(2), h)
    return out, first


@dataclass
class Classes:
    """Of the frequent words, by sorted hash: class; the end token is word 0 and alone in class 0."""

    words: np.ndarray
    of: np.ndarray
    context: np.ndarray  # log P(side and class of a neighbour | own class): [class, side * (CLASSES + 1) + class]
    prior: np.ndarray

    def at(self, h: np.ndarray) -> np.ndarray:
        """Places of the frequent words, -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1)
        near = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[near] == h, near, -1)


def _by_part(sorted_hashes: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = (sorted_hashes >> shift).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    return part[start], start, np.append(start, len(part))[1:]


def _each_block(kind: str, work: Callable[[pa.RecordBatch, int], list[tuple]]):
    """mapInArrow function: work gives the rows for the block in row i of a batch; kind is the rows' Arrow schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
        fields = [(x.split()[0], types[x.split()[1]]) for x in kind.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = work(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return run


def _learned(batch: pa.RecordBatch, i: int, folds: int, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k_id, _, texts = opened(batch, i)
    h, first = tokens(texts)
    return h, first, np.repeat(~held_out(k_id, folds, fold), np.diff(first))


_PACKED = ["block", "k_id", "k_th", "ends", "z"]


def count_words(blocks: DataFrame, shift: np.uint64, folds: int, fold: int) -> DataFrame:
    """(part, words, counts) of the training tokens, packed and summed by range."""

    def send(batch: pa.RecordBatch, i: int) -> list[tuple]:
        h, _, learn = _learned(batch, i, folds, fold)
        values, counts = np.unique(h[learn], return_counts=True)
        return [(int(p), pack(values[a:b]), pack(counts[a:b].astype(np.int32))) for p, a, b in zip(*_by_part(values, shift), strict=True)]

    def add(table: pa.Table) -> pa.Table:
        values, inverse = np.unique(np.concatenate([unpack(x.as_py(), U64) for x in table["words"]]), return_inverse=True)
        total = np.zeros(len(values), dtype=np.int64)
        np.add.at(total, inverse, np.concatenate([unpack(x.as_py(), np.int32) for x in table["counts"]]))
        return pa.table({"part": [table["part"][0].as_py()], "words": pa.array([pack(values)], pa.binary()), "counts": pa.array([pack(total)], pa.binary()), "n": [int(total.sum())], "v": [len(values)]})

    kind = "part long, words binary, counts binary"
    return blocks.select(*_PACKED).mapInArrow(_each_block(kind, send), kind).groupBy("part").applyInArrow(add, kind + ", n long, v long")


def frequent(vocabulary: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of those with at least so many tokens, by hash: at most total / least rows reach the driver."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, c = unpack(batch["words"][i].as_py(), U64), unpack(batch["counts"][i].as_py(), np.int64)
                keep = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(w[keep].view(np.int64)), pa.array(c[keep])], ["w", "c"])

    rows = vocabulary.select("words", "counts").mapInArrow(some, "w long, c long").collect()
    words = np.array([r["w"] for r in rows], dtype=np.int64).view(U64)
    counts = np.array([r["c"] for r in rows], dtype=np.int64)
    by = np.argsort(words)
    return words[by], counts[by]


def pair_counts(blocks: DataFrame, head: np.ndarray, folds: int, fold: int, parts: int) -> DataFrame:
    """(part, pairs, counts): bigrams of frequent words in the training text, each once for either word; a pair is
    word * 2**33 + side * 2**32 + neighbour, side 0 for one on the left. A part has all pairs of its words."""
    known = Classes(head, head, head, head)

    def send(batch: pa.RecordBatch, i: int) -> list[tuple]:
        h, first, learn = _learned(batch, i, folds, fold)
        at = known.at(h)
        before = np.concatenate([[-1], at[:-1]])
        before[first[:-1][first[:-1] < len(at)]] = int(known.at(np.array([END]))[0])
        ok = learn & (at >= 0) & (before >= 0)
        right, left = before[ok] << 33 | 1 << 32 | at[ok], at[ok] << 33 | before[ok]
        values, counts = np.unique(np.concatenate([right, left]), return_counts=True)
        part = (values >> 33) % parts
        by = np.argsort(part, kind="stable")
        values, counts, part = values[by], counts[by], part[by]
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
        return [(int(part[a]), pack(values[a:b]), pack(counts[a:b].astype(np.int32))) for a, b in zip(start, np.append(start, len(part))[1:], strict=True)]

    def add(table: pa.Table) -> pa.Table:
        values, inverse = np.unique(np.concatenate([unpack(x.as_py(), np.int64) for x in table["pairs"]]), return_inverse=True)
        total = np.zeros(len(values), dtype=np.int64)
        np.add.at(total, inverse, np.concatenate([unpack(x.as_py(), np.int32) for x in table["counts"]]))
        return pa.table({"part": [table["part"][0].as_py()], "pairs": pa.array([pack(values)], pa.binary()), "counts": pa.array([pack(total)], pa.binary())})

    kind = "part long, pairs binary, counts binary"
    return blocks.select(*_PACKED).mapInArrow(_each_block(kind, send), kind).groupBy("part").applyInArrow(add, kind)


def context_vectors(pairs: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """[word, side, class]: how often the words left (0) and right (1) of a frequent word are of each class."""

    def some(batch: pa.RecordBatch, i: int) -> list[tuple]:
        p, c = unpack(batch["pairs"][i].as_py(), np.int64), unpack(batch["counts"][i].as_py(), np.int64)
        cell, inverse = np.unique((p >> 32) * classes + of[p & 0xFFFFFFFF], return_inverse=True)
        return [(pack(cell), pack(np.bincount(inverse, weights=c, minlength=len(cell)).astype(np.int64)))]

    out = np.zeros(len(of) * 2 * classes, dtype=np.float64)
    # packed cells of the frequent words' vectors: at most HEAD * 2 * classes of them, each in one part only
    for r in pairs.select("pairs", "counts").mapInArrow(_each_block("cell binary, n binary", some), "cell binary, n binary").collect():
        out[unpack(r["cell"], np.int64)] = unpack(r["n"], np.int64)
    return out.reshape(len(of), 2, classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(matrix: np.ndarray) -> float:
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=1)).sum() - _xlogx(matrix.sum(axis=0)).sum())


def sweep(of: np.ndarray, vectors: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A pass of exchange over some words: each in turn, taken out of its class, enters the one that gives the class bigrams the
    greatest likelihood. Class 0 takes no part."""
    of, k = of.copy(), vectors.shape[2]
    matrix = np.zeros((k, k))
    np.add.at(matrix, of, vectors[:, 1, :])
    for w in order:
        left, right = vectors[w, 0], vectors[w, 1]
        a = of[w]
        matrix[a] -= right
        matrix[:, a] -= left
        np.maximum(matrix, 0, out=matrix)
        rows, columns = matrix.sum(axis=1), matrix.sum(axis=0)
        gain = (_xlogx(matrix + right) - _xlogx(matrix)).sum(axis=1) + (_xlogx(matrix + left[:, None]) - _xlogx(matrix)).sum(axis=0)
        gain -= _xlogx(rows + right.sum()) - _xlogx(rows) + _xlogx(columns + left.sum()) - _xlogx(columns)
        gain[0] = -np.inf
        b = int(gain.argmax())
        of[w] = b
        matrix[b] += right
        matrix[:, b] += left
    return of


def exchange(pairs: DataFrame, words: np.ndarray, counts: np.ndarray, classes: int, sweeps: int) -> Classes:
    end = int(np.searchsorted(words, END))
    order = np.argsort(-counts, kind="stable")
    order = order[order != end]
    of = np.zeros(len(words), dtype=np.int64)
    of[order] = 1 + np.random.default_rng(0).permutation(len(order)) % classes
    k = classes + 1
    best, most = of, -np.inf
    vectors = context_vectors(pairs, of, k)
    for turn in range(sweeps + 1):
        matrix = np.zeros((k, k))
        np.add.at(matrix, of, vectors[:, 1, :])
        now = likelihood(matrix)
        if now > most:
            best, most, chosen_vectors = of, now, vectors
        elif turn > 3 * QUARTERS:
            break
        if turn < sweeps:
            of = sweep(of, vectors, order[turn % QUARTERS :: QUARTERS])
            vectors = context_vectors(pairs, of, k)
    context = np.zeros((k, 2 * k))
    np.add.at(context, best, chosen_vectors.reshape(len(words), 2 * k))
    share = (context.sum(axis=1) + 1) / (context.sum() + k)
    context = (context + 0.5 + 5 * context.sum(axis=0) / max(context.sum(), 1)) / (context.sum(axis=1, keepdims=True) + k + 5)
    prior = np.log(share)
    prior[0] = -np.inf
    return Classes(words, best, np.log(context), prior)


def place_words(blocks: DataFrame, vocabulary: DataFrame, model: Classes, shift: np.uint64, folds: int, fold: int, classes: int) -> DataFrame:
    """(block, part, counts, classes, stats): for each block's distinct words of a range, in order of hash, the training
    count (0: unknown) and the class; stats, in one row of the range: tokens and words of each class."""
    k = classes + 1

    def send(batch: pa.RecordBatch, i: int) -> list[tuple]:
        h, first, learn = _learned(batch, i, folds, fold)
        values, inverse = np.unique(h, return_inverse=True)
        at = model.at(h)
        own = np.where(at >= 0, model.of[np.maximum(at, 0)] if len(model.of) else 0, -1)
        left = np.concatenate([[-1], own[:-1]])
        left[first[:-1][first[:-1] < len(h)]] = 0
        right = np.concatenate([own[1:], [-1]])
        tail = learn & (at < 0)
        cells, n = np.unique(np.concatenate([(inverse * 2 * k + left)[tail & (left >= 0)], (inverse * 2 * k + k + right)[tail & (right >= 0)]]), return_counts=True)
        word = cells // (2 * k)
        out = []
        for p, a, b in zip(*_by_part(values, shift), strict=True):
            lo, hi = np.searchsorted(word, [a, b])
            out.append((batch["block"][i].as_py(), int(p), pack(values[a:b]), pack((word[lo:hi] - a).astype(np.int32)), pack((cells[lo:hi] % (2 * k)).astype(np.int16)), pack(n[lo:hi].astype(np.int32))))
        return out

    def decide(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "counts": pa.array([], pa.binary()), "classes": pa.array([], pa.binary()), "stats": pa.array([], pa.list_(pa.int64()))})
        own = [unpack(x.as_py(), U64) for x in asked["words"]]
        values, inverse = np.unique(np.concatenate(own), return_inverse=True)
        count = np.zeros(len(values), dtype=np.int64)
        if known.num_rows:
            w, c = unpack(known["words"][0].as_py(), U64), unpack(known["counts"][0].as_py(), np.int64)
            count[np.searchsorted(values, w)] = c
        ends = np.cumsum([len(x) for x in own])
        score = np.tile(model.prior, (len(values), 1)) if len(model.prior) else np.zeros((len(values), k))
        for x, e, word, cell, n in zip(own, ends, asked["word"], asked["cell"], asked["n"], strict=True):
            spot = inverse[e - len(x) + unpack(word.as_py(), np.int32).astype(np.int64)] if len(x) else np.zeros(0, np.int64)
            if len(spot):
                np.add.at(score, spot, model.context.T[unpack(cell.as_py(), np.int16)] * unpack(n.as_py(), np.int32)[:, None])
        best = score.argmax(axis=1)
        at = model.at(values)
        best = np.where(at >= 0, model.of[np.maximum(at, 0)] if len(model.of) else 0, best)
        stats = np.concatenate([np.bincount(best[count > 0], weights=count[count > 0], minlength=k), np.bincount(best[count > 0], minlength=k)]).astype(np.int64)
        counts = [pack(count[inverse[e - len(x) : e]]) for x, e in zip(own, ends, strict=True)]
        kinds = [pack(best[inverse[e - len(x) : e]].astype(np.uint8)) for x, e in zip(own, ends, strict=True)]
        return pa.table({"block": asked["block"].combine_chunks(), "part": asked["part"].combine_chunks(), "counts": pa.array(counts, pa.binary()), "classes": pa.array(kinds, pa.binary()), "stats": pa.array([stats.tolist()] + [None] * (len(own) - 1), pa.list_(pa.int64()))})

    kind = "block long, part long, words binary, word binary, cell binary, n binary"
    sent = blocks.select(*_PACKED).mapInArrow(_each_block(kind, send), kind)
    return sent.groupBy("part").cogroup(vocabulary.select("part", "words", "counts").groupBy("part")).applyInArrow(decide, "block long, part long, counts binary, classes binary, stats array<long>")


@dataclass
class Model:
    """log10 of transitions [class before, class] (the last row: after an unknown word) and the emissions' parts."""

    total: int
    distinct: int
    step: np.ndarray
    below: np.ndarray
    unknown: np.ndarray


def _joined(batch: pa.RecordBatch, i: int, shift: np.uint64) -> tuple[np.ndarray, ...]:
    k_id, _, texts = opened(batch, i)
    h, first = tokens(texts)
    _, inverse = np.unique(h, return_inverse=True)
    answers = batch["answers"][i].as_py() or []
    counts = np.concatenate([unpack(a["counts"], np.int64) for a in answers]) if answers else np.zeros(0, np.int64)
    kinds = np.concatenate([unpack(a["classes"], np.uint8) for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
    return k_id, first, counts[inverse], kinds[inverse]


def _before(kind: np.ndarray, known: np.ndarray, first: np.ndarray, unknown: int) -> np.ndarray:
    before = np.concatenate([[0], np.where(known, kind, unknown)[:-1]])
    before[first[:-1]] = 0
    return before


def score(docs: DataFrame, folds: int = 5, fold: int = 1, head: int = HEAD, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, k = make_blocks(docs), classes + 1
    size = blocks.agg(F.sum("size")).first()[0] or 0
    shift = U64(64 - max(4, int(np.ceil(np.log2(max(1.0, size / 16 / RANGE))))))
    vocabulary = materialize(count_words(blocks, shift, folds, fold))
    total, distinct = (x or 0 for x in vocabulary.agg(F.sum("n"), F.sum("v")).first())
    words, counts = frequent(vocabulary, total / head if total else 1)
    if len(words) and words[0] != END:
        words, counts = np.concatenate([[END], words]), np.concatenate([[0], counts])
    if len(words):
        pairs = materialize(pair_counts(blocks, words, folds, fold, 4 * parts))
        model = exchange(pairs, words, counts, classes, sweeps)
    else:
        none = np.zeros(0, dtype=np.int64)
        model = Classes(none.astype(U64), none, np.zeros((k, 2 * k)), np.zeros(k))
    placed = materialize(place_words(blocks, vocabulary, model, shift, folds, fold, classes))
    stats = np.zeros(2 * k, dtype=np.int64)
    for r in placed.filter("stats IS NOT NULL").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        stats[r["at"]] = r["n"]
    answers = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "counts", "classes"))).alias("answers"))
    joined = blocks.select(*_PACKED).join(answers, "block")

    def steps(batch: pa.RecordBatch, i: int) -> list[tuple]:
        k_id, first, count, kind = _joined(batch, i, shift)
        learn = np.repeat(~held_out(k_id, folds, fold), np.diff(first))
        cells, n = np.unique((_before(kind, count > 0, first, k) * k + kind)[learn], return_counts=True)
        return list(zip(cells.tolist(), n.tolist(), strict=True))

    matrix = np.zeros((k + 1) * k)
    for r in joined.mapInArrow(_each_block("cell long, n long", steps), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # k * (k + 1) rows
        matrix[r["cell"]] = r["n"]
    matrix = matrix.reshape(k + 1, k)
    share = (stats[:k] + 0.5) / (stats[:k].sum() + 0.5 * k)
    step = (matrix + SHARE_WEIGHT * share) / (matrix.sum(axis=1, keepdims=True) + SHARE_WEIGHT)
    below = stats[:k] + 0.5 * (stats[k:] + 1)
    final = Model(int(total), int(distinct), np.log10(step), np.log10(below), np.log10((step * (0.5 / below)).sum(axis=1)))

    def rate(batch: pa.RecordBatch, i: int) -> list[tuple]:
        k_id, first, count, kind = _joined(batch, i, shift)
        known = count > 0
        before = _before(kind, known, first, k)
        base = np.log10((count + 0.5) / (final.total + 0.5 * (final.distinct + 1)))
        own = np.where(known, final.step[before, kind] + np.log10(count + 0.5) - final.below[kind], final.unknown[before])
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  a document has one token at least
        return list(zip(k_id.tolist(), held_out(k_id, folds, fold).tolist(), np.diff(first).tolist(), add(known.astype(np.int64)).tolist(), add(base).tolist(), add(own).tolist(), strict=True))

    kind = "k_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = joined.mapInArrow(_each_block(kind, rate), kind)
    return out.select(
        F.when(F.col("k_id") != NULL_ID, F.col("k_id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(final.total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
