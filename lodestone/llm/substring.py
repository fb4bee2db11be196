"""Substring dedup with prefix-partitioned suffix trees over words.

The suffixes that matter begin at anchors (see blocks): the first words of such a suffix are its prefix, and prefixes
are dealt by hash into bins that fit in memory. In a bin the trees of the suffixes to the right of the anchors and of
the reversed words to their left are built level by level, a node being (its parent, the next word). A window of 20
words is a pair of nodes, 20 - j deep to the right and j deep to the left: pairs with two or more leaves are the deep
internal nodes, that is the repeats. The node's first leaf stays, the windows of the others are removed.

A document whose whole text a smaller id has loses all its windows and takes no part (see blocks). A prefix with more than
``hot`` suffixes does not go into a bin: its suffixes are split further, by their full 20 words, and each such node is a
grouped minimum; a block decides all of its windows but the first itself and sends that one.

Words are known by 64 bits of a hash. Null or empty text: no words. Repeated rows (id and text) are one document, of which
each row keeps the same; texts of one id are ordered by their key. A null id comes first. A very long text is a block of its
own, handled whole. An empty table gives an empty result. Other columns may have any names: ``strip`` carries them in one struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import chosen, copies, coverage, hot_rows, make_blocks, opened, pack, ranges, repeated_anchors, runs_of_windows, span_table, unpack, whole_copies
from lodestone.llm.storage import materialize
from lodestone.llm.text import NULL_ID, Words, keyed_struct, mix, rolling

U64 = np.uint64
WINDOW, GRAM = 20, 6
#: Suffixes of one prefix beyond which it is split by full windows; suffixes that a bin is to hold.
HOT, BIN = 250_000, 150_000


def _anchors(batch: pa.RecordBatch, i: int, window: int, gram: int) -> tuple:
    """The ids, the words and their hashes, copies, and of each anchor its hash, place, first and last window."""
    k_id, k_th, texts = opened(batch, i)
    w, gone = Words(texts), copies(batch, i, k_id)
    h = w.hashes()
    grams = rolling(h, gram)
    at, lo, hi = runs_of_windows(grams, np.where(np.repeat(gone, w.count), 0, w.room()), window, gram)
    return k_id, k_th, w, h, gone, grams[at], at, lo, hi


def trees(key: np.ndarray, words: np.ndarray, first: np.ndarray, size: np.ndarray, anchor: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window start in it) of every window that an earlier context has too. words[first : first + size] are
    a context's words (numbers from 0), anchor the place of its anchor in them; order: equal for contexts of one place, else
    earlier ones less."""
    by = np.argsort(order, kind="stable")
    key, first, size, anchor, order = key[by], first[by], size[by], anchor[by], order[by]
    wide = np.int64(words.max()) + 2 if len(words) else np.int64(2)
    node = np.unique(key, return_inverse=True)[1].astype(np.int32)
    right, left = [node], [np.zeros(len(key), dtype=np.int32)]
    for d in range(window):
        word = np.where(anchor + d < size, words[np.minimum(first + anchor + d, len(words) - 1)] + 1, 0)
        right.append(np.unique(right[-1] * wide + word, return_inverse=True)[1].astype(np.int32))
    most = int(anchor.max()) if len(anchor) else 0
    for d in range(1, most + 1):
        word = np.where(anchor >= d, words[np.maximum(first + anchor - d, 0)] + 1, 0)
        left.append(np.unique(left[-1] * wide + word, return_inverse=True)[1].astype(np.int32))
    which, start = [], []
    for j in range(min(most, window) + 1):
        own = np.flatnonzero((anchor >= j) & (size - anchor >= window - j))
        if not len(own):
            continue
        pair = right[window - j][own] * np.int64(left[j].max() + 1) + left[j][own]
        _, head, inverse = np.unique(pair, return_index=True, return_inverse=True)
        later = order[own] > order[own][head][inverse]
        which.append(own[later])
        start.append((anchor[own] - j)[later])
    if not which:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return by[np.concatenate(which)], np.concatenate(start)


def _contexts(window: int, gram: int, bins: int, shift: np.uint64):
    """(block, bin, meta, names, words): the contexts of a block's repeated anchors for one bin, their words by number, and the
    words' hashes. Hot anchors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k_id, k_th, w, h, _, key, at, lo, hi = _anchors(batch, i, window, gram)
                twice, often = chosen(key, batch["answers"][i].as_py(), shift)
                doc = w.doc_of_word()[at]
                where = (mix(key ^ U64(0x51ED270B)) >> U64(33)).astype(np.int64) % bins
                own = np.flatnonzero(twice & ~often)
                own = own[np.argsort(where[own], kind="stable")]
                edge = np.flatnonzero(np.concatenate([[True], where[own][1:] != where[own][:-1]])) if len(own) else own
                out = []
                for a, b in zip(edge, np.append(edge, len(own))[1:], strict=True):
                    c = own[a:b]
                    size = hi[c] + window - lo[c]
                    meta = [key[c].view(np.int64), k_id[doc[c]], k_th[doc[c]], doc[c], lo[c] - w.first[doc[c]], size, at[c] - lo[c]]
                    names, words = np.unique(h[ranges(lo[c], size)], return_inverse=True)
                    out.append((batch["block"][i].as_py(), int(where[c[0]]), pack(np.concatenate(meta).astype(np.int64)), pack(names), pack(words.astype(np.int32))))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["block", "bin", "meta", "names", "words"])

    return run


def _bin(window: int):
    def run(table: pa.Table) -> pa.Table:
        metas = [unpack(x.as_py(), np.int64).reshape(7, -1) for x in table["meta"]]
        # the words' numbers in the bin, from their numbers in the parts: the words themselves are never laid out
        names = [unpack(x.as_py(), U64) for x in table["names"]]
        number = np.unique(np.concatenate(names), return_inverse=True)[1].astype(np.int32)
        before = np.cumsum([0] + [len(x) for x in names])
        words = np.concatenate([number[a + unpack(y.as_py(), np.int32)] for a, y in zip(before[:-1], table["words"], strict=True)])
        del names, number
        block = np.repeat(table["block"].to_numpy(), [m.shape[1] for m in metas])
        key, k_id, k_th, doc, lo, size, anchor = np.concatenate(metas, axis=1)
        place = np.lexsort((lo + anchor, k_th, k_id))
        same = (np.diff(k_id[place]) == 0) & (np.diff(k_th[place]) == 0) & (np.diff((lo + anchor)[place]) == 0)
        order = np.empty(len(place), dtype=np.int64)
        order[place] = np.concatenate([[0], np.cumsum(~same)]) if len(place) else 0
        which, start = trees(key.view(U64), words, np.cumsum(size) - size, size, anchor, order, window)
        by = np.lexsort((start, which))
        which, start = which[by], start[by]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)]) if len(which) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(which)) - 1 if len(a) else a
        return span_table(block[which[a]], doc[which[a]], lo[which[a]] + start[a], lo[which[a]] + start[b] + window)

    return run


def _hot_windows(window: int, gram: int, shift: np.uint64):
    """(block, h1, h2, k_id, k_th, doc, start) of the first place of each window of a block's hot anchors; one row has the spans
    of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k_id, k_th, w, h, _, key, _, lo, hi = _anchors(batch, i, window, gram)
                _, often = chosen(key, batch["answers"][i].as_py(), shift)
                own = np.flatnonzero(often)
                at = ranges(lo[own], hi[own] - lo[own] + 1)
                one, two = rolling(h, window)[at], rolling(mix(h ^ U64(0x2545F4914F6CDD1D)), window)[at]
                doc = w.doc_of_word()[at]
                start = at - w.first[doc]
                by = np.lexsort((start, k_th[doc], k_id[doc], two, one))
                one, two, doc, start = one[by], two[by], doc[by], start[by]
                new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(at)]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                same = (k_id[doc] == k_id[doc][first]) & (k_th[doc] == k_th[doc][first]) & (start == start[first])
                block = np.full(len(at), batch["block"][i].as_py())
                yield from hot_rows(~same, start, window, block=block, h1=one.view(np.int64), h2=two.view(np.int64), k_id=k_id[doc], k_th=k_th[doc], doc=doc)

    return run


_PACKED = ["block", "size", "k_id", "k_th", "names", "ends", "z"]


def repeats(blocks: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bin_size: int = BIN) -> DataFrame:
    """(block, spans): the word spans of each block's documents (with heads, see whole_copies) that earlier windows have too, packed."""
    bits, shift, any_hot = repeated_anchors(blocks, lambda batch, i: _anchors(batch, i, window, gram)[5], 1 / 40, hot)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    # at most every 40th byte begins a suffix, so a bin holds bin_size of them or fewer, but for one hot prefix at most
    bins = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / 40 / bin_size) + 1)
    parts = blocks.join(bits, "block").mapInArrow(_contexts(window, gram, bins, shift), "block long, bin long, meta binary, names binary, words binary")
    cold = parts.groupBy("bin").applyInArrow(_bin(window), "block long, spans binary")
    if not any_hot:
        return cold
    kind = "block long, h1 long, h2 long, k_id long, k_th long, doc long, start long, spans binary"
    rows = materialize(blocks.join(bits.filter("hot"), "block").mapInArrow(_hot_windows(window, gram, shift), kind))
    place, first = F.struct("k_id", "k_th", "start"), rows.filter("spans IS NULL")
    heads = first.groupBy("h1", "h2").agg(F.min(place).alias("head"), F.max(place).alias("last")).filter("head < last").drop("last")
    gone = first.join(heads, ["h1", "h2"]).filter(place > F.col("head")).select("block", "doc", "start")

    def packed(table: pa.Table) -> pa.Table:
        block, doc, start = (table[c].to_numpy() for c in ("block", "doc", "start"))
        return span_table(block, doc, start, start + window)

    known = rows.filter("spans IS NOT NULL").select("block", "spans")
    return cold.unionByName(known).unionByName(gone.groupBy("block").applyInArrow(packed, "block long, spans binary"))


def _results(texts_too: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k_id, k_th, texts = opened(batch, i)
                w = Words(texts)
                gone = coverage(batch["spans"][i].as_py(), w.first, len(w.start)) | np.repeat(copies(batch, i, k_id) & (w.count >= window), w.count)
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (w.count > 0) if len(w) else w.count
                sha, kept = [], []
                for d, text in enumerate(texts):
                    words = text.as_py().split()
                    if removed[d]:
                        words = [x for x, g in zip(words, gone[w.first[d] : w.first[d + 1]].tolist(), strict=True) if not g]
                    joined = b" ".join(words)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    kept.append(joined.decode() if removed[d] and texts_too else None)
                arrays = [pa.array(x, pa.int64()) for x in (k_id, k_th, w.count, removed)] + [pa.array(sha, pa.string()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["k_id", "k_th", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def examine(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bin_size: int = BIN, texts_too: bool = False) -> DataFrame:
    """For each row: k_id, k_th, n_words, n_removed, kept_sha256, kept_text (if asked for, and any word goes)."""
    blocks = make_blocks(docs)
    blocks = blocks.join(whole_copies(blocks), "block", "left").select(*_PACKED, "heads")
    spans = materialize(repeats(blocks, window, gram, hot, bin_size).groupBy("block").agg(F.collect_list("spans").alias("spans")))
    out = "k_id long, k_th long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return blocks.join(spans, "block", "left").mapInArrow(_results(texts_too, window), out)


def report(docs: DataFrame, **options: int) -> DataFrame:
    return examine(docs, **options).select(F.when(F.col("k_id") != NULL_ID, F.col("k_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def strip(docs: DataFrame, **options: int) -> DataFrame:
    """docs with the repeated words taken out of the texts: what is left is joined by one space; other texts stay as they
    are. n_chars, where there is such a column, follows."""
    changed = examine(docs, texts_too=True, **options).filter("n_removed > 0").select("k_id", "k_th", "kept_text").dropDuplicates(["k_id", "k_th"])
    nested = keyed_struct(docs).join(changed, ["k_id", "k_th"], "left")
    text = F.coalesce("kept_text", F.col("row")["text"])
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        length = F.when(F.col("kept_text").isNull(), columns["n_chars"]).otherwise(F.length(text))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return nested.select(*(x.alias(c) for c, x in columns.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
