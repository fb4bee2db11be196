"""Suffix-array dedup by merging the Burrows-Wheeler transforms of shards.

Only strings around repeated anchors (see blocks) can hold a repeated window. Each block of documents sends its distinct ones,
dealt by the anchor's hash into bins. In a bin, strings with the same bytes are one string of several places, known by 64 bits
of a hash; one that neither occurs in two documents nor shares more than its anchor with another string is left out. The
others are cut into shards; each shard is sorted once, and of its order only the transform is used further: the shards'
transforms are merged by interleave refinement. Every shard's rows stay in order, and the interleave is refined by the first
eight symbols, then by twice as many in each round, which the transform's own steps give: rows with the same first n symbols
are ordered by the interval of the row n symbols ahead. Where a round parts two neighbours their common prefix ends; neighbours
that no round has parted when the window's length is reached share a whole window: the repeated intervals. No suffix is
sorted again. An interval's least document stays; its bytes in all others are removed.

A document whose whole text a smaller id has loses all its windows and takes no part (see blocks). An anchor with more
than ``hot`` places does not go into a bin: its windows are grouped minima, of which a block sends one for each window.

Null or empty text: no bytes. Repeated rows, and all rows of one id, do not count as earlier for each other; a null id
comes before all others. A very long text is a block of its own, handled whole. An empty table gives an empty result. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import chosen, copies, coverage, hot_rows, make_blocks, opened, pack, ranges, repeated_anchors, runs_of_windows, span_table, squeeze, stretch, unpack, whole_copies
from lodestone.llm.storage import materialize
from lodestone.llm.text import NULL_ID, binary_buffers, hash_between, mix, spans_hash, sums_of, window_hashes, window_hashes_at

U64 = np.uint64
WINDOW, GRAM = 50, 24
#: Places of one anchor beyond which it is not held in a bin; bytes of text a bin stands for.
HOT, BIN_BYTES = 250_000, 12_000_000
#: Bytes of strings that are merged at once (more where one anchor has more), and of one shard.
CHUNK, SHARD = 1 << 20, 1 << 18
#: A byte that no UTF-8 text has ends each string.
END = 0xFF


def _anchors(batch: pa.RecordBatch, i: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """k_id, bytes, offsets, copies, and of each anchor its hash, place, first and last window."""
    k_id, _, texts = opened(batch, i)
    data, offsets = binary_buffers(texts)
    gone = copies(batch, i, k_id)
    room = np.repeat(np.where(gone, 0, offsets[1:]), np.diff(offsets)) - np.arange(len(data))
    grams = window_hashes(data, gram)
    at, lo, hi = runs_of_windows(grams, room[: len(grams)], window, gram)
    return k_id, data, offsets, gone, grams[at], at, lo, hi


def shard_transform(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transform of strings (text: their bytes, each with END; size: with it) and the places of their sorted
    rotations. Prefix doubling on eight bytes at first, then on rows that are not told apart yet; the strings must differ."""
    n = len(text)
    if not n:
        return text, np.zeros(0, dtype=np.int64)
    stop, length, here = np.repeat(np.cumsum(size), size), np.repeat(size, size), np.arange(n)

    def ahead(at: np.ndarray, k: int) -> np.ndarray:
        to = at + k
        far = np.flatnonzero(to >= stop[at])
        own = at[far]
        to[far] -= ((to[far] - stop[own]) // length[own] + 1) * length[own]
        return to

    key = text.astype(U64)
    for k in (1, 2, 4):
        key = (key << U64(8 * k)) | key[ahead(here, k)]
    order = np.argsort(key)
    key, items, place = key[order], order.copy(), here
    rank, depth, most = np.empty(n, dtype=np.int64), 8, 2 * int(size.max())
    while True:
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(head, len(key)))
        rank[items] = np.repeat(place[head], many)
        alike = np.repeat(many > 1, many)
        place, items = place[alike], items[alike]
        if not len(place) or depth >= most:
            break
        key = (rank[items].astype(U64) << U64(32)) | rank[ahead(items, depth)].astype(U64)
        by = np.argsort(key)
        key, items = key[by], items[by]
        order[place] = items
        depth *= 2
    return text[np.where(here == stop - length, stop, here)[order] - 1], order


def _interleave(key: np.ndarray) -> np.ndarray:
    """The interval of each row in the order of keys. Every shard's rows come in order, so a stable sort merges runs."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.empty(len(key), dtype=U64)
    out[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])[: len(key)])
    return out


def merged_intervals(transforms: list[np.ndarray], depth: int) -> np.ndarray:
    """For each row of each shard, one shard after the other, the number of its interval: of the rows, in merged order, whose
    first ``depth`` symbols are the same."""
    if not sum(map(len, transforms)):
        return np.zeros(0, dtype=np.int64)
    every, base, step = np.concatenate(transforms), 0, []
    for t in transforms:  # the n-th row that begins with a symbol is followed by the n-th row that this symbol comes before
        step.append(np.argsort(t, kind="stable").astype(np.int32) + np.int32(base))
        base += len(t)
    ahead, done = {1: np.concatenate(step)}, 1
    key = every[ahead[1]].astype(U64)
    while done < min(8, depth) and 2 * done <= depth:
        key = (key << U64(8 * done)) | key[ahead[done]]
        ahead[2 * done] = ahead[done][ahead[done]]
        done *= 2
    group = _interleave(key)
    while done < depth:
        on, to = min(done, depth - done), None
        for k, rows in ahead.items():
            if on & k:
                to = rows if to is None else to[rows]
        group = _interleave((group << U64(32)) | group[to])
        if done * 2 <= depth:
            ahead[2 * done] = ahead[done][ahead[done]]
        done += on
    return group.astype(np.int64)


def _contexts(window: int, gram: int, bins: int, shift: np.uint64):
    """(block, bin, strings, places, z): for each bin the block's distinct strings around repeated anchors (size, anchor; their
    bytes), and each anchor's document id, document, place and string. Hot anchors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k_id, data, offsets, _, key, at, lo, hi = _anchors(batch, i, window, gram)
                twice, often = chosen(key, batch["answers"][i].as_py(), shift)
                own = np.flatnonzero(twice & ~often)
                size = hi[own] + window - lo[own]
                where = (mix(key[own] ^ U64(0x51ED270B)) >> U64(33)).astype(np.int64) % bins
                _, head, string = np.unique(spans_hash(data, lo[own], lo[own] + size), return_index=True, return_inverse=True)
                by = np.argsort(where[head], kind="stable")
                rank = np.empty(len(by), dtype=np.int64)
                rank[by] = np.arange(len(by))
                head, string = head[by], rank[string]
                doc = np.searchsorted(offsets, lo[own], "right") - 1
                order = np.argsort(string, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], where[head][1:] != where[head][:-1]])) if len(head) else head
                split = np.searchsorted(string[order], np.append(edge, len(head)))
                out = []
                for a, b, c, d in zip(edge.tolist(), [*edge[1:].tolist(), len(head)], split[:-1], split[1:], strict=True):
                    h, p = head[a:b], order[c:d]
                    strings = np.concatenate([size[h], at[own[h]] - lo[own[h]]]).astype(np.int32)
                    places = np.concatenate([k_id[doc[p]], doc[p], lo[own[p]] - offsets[doc[p]], string[p] - a]).astype(np.int64)
                    out.append((batch["block"][i].as_py(), int(where[h[0]]), pack(strings), pack(places), squeeze(data[ranges(lo[own[h]], size[h])].tobytes())))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["block", "bin", "strings", "places", "z"])

    return run


def _least(data: np.ndarray, first: np.ndarray, size: np.ndarray, lowest: np.ndarray, window: int) -> np.ndarray:
    """The least document id of each window's interval, for strings data[first : first + size] in this order, window by window."""
    length = size + 1
    text = np.full(int(length.sum()), END, dtype=np.uint8)
    begin = np.cumsum(length) - length
    text[ranges(begin, size)] = data[ranges(first, size)]
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], begin // SHARD])))
    rows, transforms = [], []
    for a, b in zip(edge, np.append(edge, len(size))[1:], strict=True):
        lo, hi = begin[a], begin[b - 1] + length[b - 1]
        transform, place = shard_transform(text[lo:hi], length[a:b])
        transforms.append(transform)
        rows.append(place + lo)
    interval = np.empty(len(text), dtype=np.int64)
    interval[np.concatenate(rows)] = merged_intervals(transforms, window)
    spot = interval[ranges(begin, size - window + 1)]
    least = np.full(int(spot.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, spot, np.repeat(lowest, size - window + 1))
    return least[spot]


def _bin(window: int, gram: int):
    half = (window - gram) // 2

    def run(table: pa.Table) -> pa.Table:
        parts, base, total = [], 0, 0
        for strings, places, z in zip(table["strings"], table["places"], table["z"], strict=True):
            size, anchor = unpack(strings.as_py(), np.int32).reshape(2, -1).astype(np.int64)
            data = np.frombuffer(stretch(z.as_py()), dtype=np.uint8)
            sums, first = sums_of(data), np.cumsum(size) - size
            name, key = hash_between(sums, first, first + size), hash_between(sums, first + anchor, first + anchor + gram)
            parts.append((data, first + total, size, anchor, name, key, unpack(places.as_py(), np.int64).reshape(4, -1), base))
            base, total = base + len(size), total + len(data)
        data, first, size, anchor, name, key = (np.concatenate([p[k] for p in parts]) for k in range(6))
        _, head, same = np.unique(name, return_index=True, return_inverse=True)
        first, size, anchor, key = first[head], size[head], anchor[head], key[head]
        lowest, highest = np.full(len(head), np.iinfo(np.int64).max), np.full(len(head), np.iinfo(np.int64).min)
        for p in parts:
            string = same[p[6][3] + p[7]]
            np.minimum.at(lowest, string, p[6][0])
            np.maximum.at(highest, string, p[6][0])
        # a window reaches over its anchor by half of the rest on one side at least
        wanted = lowest < highest
        for before, after in ((half, 0), (0, half)):
            long = np.flatnonzero((anchor >= before) & (anchor + gram + after <= size))
            a = first[long] + anchor[long] - before
            _, inverse, count = np.unique(window_hashes_at(data, a, gram + half), return_inverse=True, return_counts=True)
            wanted[long] |= count[inverse] > 1
        wanted = np.flatnonzero(wanted)
        # chunks of whole anchors; in a chunk strings come as their blocks sent them
        wanted = wanted[np.argsort(key[wanted], kind="stable")]
        new = np.flatnonzero(np.concatenate([[True], key[wanted][1:] != key[wanted][:-1]])) if len(wanted) else wanted
        reach = np.cumsum(size[wanted] + 1)
        cut = [0, *(new[1:][np.diff(reach[new[1:] - 1] // CHUNK, prepend=0) > 0].tolist() if len(new) > 1 else ()), len(wanted)]
        least_at, least, offset = np.zeros(len(head), dtype=np.int64), [], 0
        n_windows = np.zeros(len(head), dtype=np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a < b:
                w = wanted[a:b]
                w = w[np.argsort(head[w])]
                n_windows[w] = size[w] - window + 1
                least_at[w] = offset + np.cumsum(n_windows[w]) - n_windows[w]
                least.append(_least(data, first[w], size[w], lowest[w], window))
                offset += len(least[-1])
        least = np.concatenate(least) if least else np.zeros(0, dtype=np.int64)
        out = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
        for block, p in zip(table["block"].to_pylist(), parts, strict=True):
            k_id, doc, start, string = p[6]
            string = same[string + p[7]]
            some = np.flatnonzero(n_windows[string])
            of = np.repeat(some, n_windows[string[some]])
            spot = ranges(least_at[string[some]], n_windows[string[some]])
            gone = np.flatnonzero(least[spot] < k_id[of])
            of, step = of[gone], spot[gone] - least_at[string[of[gone]]]
            a = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (step[1:] != step[:-1] + 1)])) if len(of) else of
            b = np.append(a, len(of))[1:] - 1
            for x, v in zip(out, (np.full(len(a), block), doc[of[a]], start[of[a]] + step[a], start[of[a]] + step[b] + window), strict=True):
                x.append(v)
        return span_table(*(np.concatenate(x) for x in out))

    return run


def _hot_windows(window: int, gram: int, shift: np.uint64):
    """Of each window of the block's hot anchors: (block, h1, h2, k_id, doc, start) where the block has it in the document of the
    least id; the places in other documents are known to be later ones: one row has their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k_id, data, offsets, _, key, _, lo, hi = _anchors(batch, i, window, gram)
                _, often = chosen(key, batch["answers"][i].as_py(), shift)
                own = np.flatnonzero(often)
                at = ranges(lo[own], hi[own] - lo[own] + 1)
                one, two = window_hashes_at(data, at, window), window_hashes_at(data[::-1], len(data) - at - window, window)
                doc = np.searchsorted(offsets, at, "right") - 1
                by = np.lexsort((k_id[doc], two, one))
                at, one, two, doc = at[by], one[by], two[by], doc[by]
                new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(at)]
                lowest = k_id[doc][np.flatnonzero(new)][np.cumsum(new) - 1]
                start, later, block = at - offsets[doc], k_id[doc] > lowest, np.full(len(at), batch["block"][i].as_py())
                yield from hot_rows(later, start, window, block=block, h1=one.view(np.int64), h2=two.view(np.int64), k_id=k_id[doc], doc=doc)

    return run


_PACKED = ["block", "size", "k_id", "k_th", "names", "ends", "z"]


def repeats(blocks: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """(block, spans): the byte spans of each block's documents (with heads, see whole_copies) that documents of smaller ids have
    too, packed."""
    bits, shift, any_hot = repeated_anchors(blocks, lambda batch, i: _anchors(batch, i, window, gram)[4], 2 / (window - gram), hot)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    bins = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / bin_bytes) + 1)
    parts = blocks.join(bits, "block").mapInArrow(_contexts(window, gram, bins, shift), "block long, bin long, strings binary, places binary, z binary")
    cold = parts.groupBy("bin").applyInArrow(_bin(window, gram), "block long, spans binary")
    if not any_hot:
        return cold
    kind = "block long, h1 long, h2 long, k_id long, doc long, start long, spans binary"
    rows = materialize(blocks.join(bits.filter("hot"), "block").mapInArrow(_hot_windows(window, gram, shift), kind))
    first = rows.filter("spans IS NULL")
    heads = first.groupBy("h1", "h2").agg(F.min("k_id").alias("head"), F.max("k_id").alias("last")).filter("head < last").drop("last")
    gone = first.join(heads, ["h1", "h2"]).filter("k_id > head").select("block", "doc", "start")

    def packed(table: pa.Table) -> pa.Table:
        block, doc, start = (table[c].to_numpy() for c in ("block", "doc", "start"))
        return span_table(block, doc, start, start + window)

    known = rows.filter("spans IS NOT NULL").select("block", "spans")
    return cold.unionByName(known).unionByName(gone.groupBy("block").applyInArrow(packed, "block long, spans binary"))


def _results(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k_id, k_th, texts = opened(batch, i)
                data, offsets = binary_buffers(texts)
                gone, size = coverage(batch["spans"][i].as_py(), offsets[:-1], len(data)), np.diff(offsets)
                gone |= np.repeat(copies(batch, i, k_id) & (size >= window), size)
                removed, runs, sha = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64), []
                for d in range(len(size)):
                    own, cut = data[offsets[d] : offsets[d + 1]], gone[offsets[d] : offsets[d + 1]]
                    if cut.any():
                        removed[d] = cut.sum()
                        runs[d] = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                        own = own[~cut]
                    sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k_id, k_th, size, removed, runs)] + [pa.array(sha, pa.string())], ["k_id", "k_th", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def examine(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """For each row: k_id, k_th, n_bytes, n_removed, n_spans, kept_sha256."""
    blocks = make_blocks(docs)
    blocks = blocks.join(whole_copies(blocks), "block", "left").select(*_PACKED, "heads")
    spans = materialize(repeats(blocks, window, gram, hot, bin_bytes).groupBy("block").agg(F.collect_list("spans").alias("spans")))
    return blocks.join(spans, "block", "left").mapInArrow(_results(window), "k_id long, k_th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def report(docs: DataFrame, **options: int) -> DataFrame:
    return examine(docs, **options).select(F.when(F.col("k_id") != NULL_ID, F.col("k_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
