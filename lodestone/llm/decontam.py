"""Benchmark decontamination with suffix arrays of the training text.

Each slice of documents is a shard with a word-level suffix array of its own; every suffix of every benchmark item is
binary-searched in it, word by word, which gives the ranges of verbatim matches and their places. Suffixes whose first
two words stand together nowhere in the benchmark (and whose first word is no whole item) can match nothing and are
left out of the array. Documents are never split, so a shard's answer about its documents is final: one map pass, no
shuffle. The benchmark goes to the executors in blocks of at most ``block_bytes`` of text; further blocks
are passes of their own whose spans are merged by document.

Null or empty texts have no words and match nothing; items without words are ignored. Items that repeat an id count
once for it; a null item id counts as no item but its words are still hit. Rows that repeat id and text get the same
row each. Empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import Words, keyed, slices

WINDOW = 10
BLOCK_BYTES = 32_000_000
SPANS = "spans array<struct<start:long,end:long>>, items array<string>, longest long"


@dataclass
class Items:
    """The benchmark's words as numbers of a sorted vocabulary: suffix[t] .. are the places of the windows to search."""

    vocabulary: np.ndarray
    words: np.ndarray
    at: np.ndarray
    depth: np.ndarray
    item: np.ndarray
    ids: list
    pairs: np.ndarray
    single: np.ndarray


def read_items(ids: list, texts: list[str | None], window: int) -> Items | None:
    w = Words(pa.array(texts, pa.string()), "alnum", lower=True)
    if not len(w.start):
        return None
    h = w.hashes()
    vocabulary = np.unique(h)
    words = np.searchsorted(vocabulary, h) + 1
    n = np.repeat(w.count, w.count)
    depth = np.minimum(window, n)
    at = np.flatnonzero(w.room() >= depth)
    first = np.flatnonzero(w.room() >= 2)
    return Items(vocabulary, words, at, depth[at], w.doc_of_word()[at], ids, np.unique(words[first] * len(vocabulary) * 2 + words[np.minimum(first + 1, len(words) - 1)]), np.unique(words[at[depth[at] == 1]]))


def matches(items: Items, w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word place, test suffix) of all verbatim window matches in the shard."""
    h = w.hashes()
    quick = np.zeros(1 << 20, dtype=bool)
    quick[(items.vocabulary >> np.uint64(44)).astype(np.int64)] = True
    known = np.flatnonzero(quick[(h >> np.uint64(44)).astype(np.int64)])
    near = np.minimum(np.searchsorted(items.vocabulary, h[known]), len(items.vocabulary) - 1)
    word = np.zeros(len(h) + 1, dtype=np.int64)
    word[known] = np.where(items.vocabulary[near] == h[known], near + 1, 0)
    room = w.room()
    place = np.flatnonzero(word[:-1])
    next_word = np.where(room[place] > 1, word[place + 1], 0)
    start = place[np.isin(word[place] * len(items.vocabulary) * 2 + next_word, items.pairs) & (next_word > 0) | np.isin(word[place], items.single)]
    if not len(start):
        return start, start
    most = int(items.depth.max())
    columns = np.stack([np.where(room[start] > d, word[np.minimum(start + d, len(h))], -1) for d in range(most)])
    order = np.lexsort(columns[::-1])  # the suffix array of the shard, to the windows' depth
    columns, start = columns[:, order], start[order]

    lo, hi = np.zeros(len(items.at), dtype=np.int64), np.full(len(items.at), len(start))
    group, wide = np.zeros(len(start), dtype=np.int64), np.int64(len(items.vocabulary) + 2)
    mine = np.zeros(len(items.at), dtype=np.int64)
    for d in range(most):
        live = np.flatnonzero((items.depth > d) & (lo < hi))
        if not len(live):
            break
        key = group * wide + columns[d] + 1
        wanted = mine[live] * wide + items.words[items.at[live] + d] + 1
        lo[live], hi[live] = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        mine[live] = group[np.minimum(lo[live], len(group) - 1)]
    found = np.maximum(hi - lo, 0)
    test = np.repeat(np.arange(len(found)), found)
    rank = np.repeat(lo, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    return start[rank], test


def _scan(items: Items | None, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part["text"], "alnum", lower=True)
                n = len(w)
                spans, named, longest = [[] for _ in range(n)], [[] for _ in range(n)], np.zeros(n, dtype=np.int64)
                place, test = matches(items, w, window) if items else (np.zeros(0, np.int64),) * 2
                if len(place):
                    change = np.zeros(len(w.start) + 1, dtype=np.int64)
                    np.add.at(change, place, 1)
                    np.add.at(change, place + items.depth[test], -1)
                    doc = w.doc_of_word()
                    owner = doc[place]
                    for d in np.unique(owner):
                        a, b = w.first[d], w.first[d + 1]
                        covered = np.cumsum(change[a : b + 1])[: b - a] > 0 if b - a else change[:0]
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                        spans[d] = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                    for d, i in sorted(set(zip(owner.tolist(), items.item[test].tolist(), strict=True))):
                        if items.ids[i] is not None:
                            named[d].append(items.ids[i])
                    # consecutive matches of one item on one diagonal make up a longer one
                    diagonal, at = place - items.at[test], np.lexsort((place, items.item[test], place - items.at[test]))
                    p, g, t = place[at], diagonal[at], test[at]
                    new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (g[1:] != g[:-1]) | (items.item[t][1:] != items.item[t][:-1])])
                    run_of = np.cumsum(new) - 1
                    np.maximum.at(longest, doc[p[new]], np.bincount(run_of) - 1 + items.depth[t[new]])
                yield pa.RecordBatch.from_arrays(
                    [part["k_id"], part["k_th"], part["doc_id"], pa.array(w.count.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(set(x)) for x in named], pa.list_(pa.string())), pa.array(longest)],
                    ["k_id", "k_th", "doc_id", "n_words", "spans", "items", "longest"],
                )

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: doc_id, n_words, spans of hit words (disjoint, in order), the ids of the items found, and longest,
    the number of words of the longest verbatim match."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    rows = keyed(docs.select("doc_id", "text")).withColumn("doc_id", F.when(F.col("k_id") != -(1 << 63), F.col("k_id")))
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    found = []
    for k in range(blocks):
        mine = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        got = sorted(mine.collect(), key=lambda r: (r["item_id"] or "", r["text"]))  # at most block_bytes of text
        items = read_items([r["item_id"] for r in got], [r["text"] for r in got], window)
        found.append(rows.mapInArrow(_scan(items, window), "k_id long, k_th long, doc_id long, n_words long, " + SPANS))
    if blocks == 1:
        return found[0].drop("k_id", "k_th")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    joined = every.filter(F.size("spans") > 0).groupBy("k_id", "k_th").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"), F.max("longest").alias("most")
    )
    none = F.array().cast("array<struct<start:long,end:long>>")
    merged = F.aggregate(
        "all_spans", none,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    out = found[0].select("k_id", "k_th", "doc_id", "n_words").join(joined, ["k_id", "k_th"], "left")
    return out.select("doc_id", "n_words", F.coalesce(merged, none).alias("spans"), F.coalesce("all_items", F.array().cast("array<string>")).alias("items"), F.coalesce("most", F.lit(0)).alias("longest"))


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "longest",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = -(-size // block_bytes) or 1, docs
    for k in range(blocks):
        got = benchmark.select("text").filter("text IS NOT NULL").filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()  # at most block_bytes of text
        items = read_items([None] * len(got), [r["text"] for r in got], window)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, dtype=bool)
                    if items:
                        w = Words(part["text"], "alnum", lower=True)
                        place, _ = matches(items, w, window)
                        keep[w.doc_of_word()[place]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
