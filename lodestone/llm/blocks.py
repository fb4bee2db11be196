"""Blocks of whole documents, and the search for what repeats between them.

A block is one row: about a megabyte of texts, compressed, with the keys of its documents. The table of blocks is bucketed, so
joining it with answers to its blocks moves the answers only, and what a block has to say to others travels as a few packed arrays instead of a row for
each position.

Anchors: a window of W consecutive symbols (words or bytes) is known by the least hash among its k-symbol grams, so
equal windows have the same anchor at the same place. Only windows whose anchor occurs twice or more can repeat.
``repeated_anchors`` finds those by ranges of the hash: each block sends the sorted anchors of a range once, packed;
the range's task answers each block with a bitmap. A range's task holds about RANGE anchors, at most one for each
block and anchor.

Whole copies: of documents with the same text only the one of the least id can be the first of anything, so the others
are known as copies beforehand (``whole_copies``) and send no anchors: a text that a third of all rows share is then one
text. Each block sends a text once, and grouped minima are combined before the shuffle.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import bucketed, materialize
from lodestone.llm.text import binary_buffers, give_back, keyed, mix, slices

U64 = np.uint64
BLOCK_BYTES = 1_000_000
#: Anchors that the task of one range of hashes is to hold.
RANGE = 1_000_000
#: Bits of an anchor's hash that count.
BITS = 48
_CHUNK, _AT = 1 << 23, U64((1 << 24) - 1)


@functools.cache
def _tools() -> tuple:
    """One compressor for arrays, one for texts and a decompressor for each process."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(array: np.ndarray) -> bytes:
    """A compressed array, byte by byte of its elements' places, so that sorted or small values shrink."""
    raw = np.ascontiguousarray(array)
    return _tools()[0].compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes()) if raw.size else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_tools()[2].decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze(data: bytes | memoryview) -> bytes:
    return _tools()[1].compress(data)


def stretch(data: bytes) -> bytes:
    return _tools()[2].decompress(data)


def make_blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """block, size, k_id, k_th and names (packed; a name is 128 bits of a hash of the text), ends (packed, of the texts),
    z (the texts); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=size):
                data, offsets = binary_buffers(part["text"])
                raw = memoryview(data)
                named = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                packed = [pack(part[c].to_numpy()) for c in ("k_id", "k_th")] + [pack(np.frombuffer(named, dtype=U64)), pack(offsets), squeeze(raw)]
                yield pa.RecordBatch.from_arrays([pa.array([len(data)]), *(pa.array([x], pa.binary()) for x in packed)], ["size", "k_id", "k_th", "names", "ends", "z"])

    kind = "size long, k_id binary, k_th binary, names binary, ends binary, z binary"
    return bucketed(keyed(docs).mapInArrow(run, kind).withColumn("block", F.monotonically_increasing_id()), "block")


def whole_copies(blocks: DataFrame) -> DataFrame:
    """(block, heads): of the block's texts that stand elsewhere too, the name and the least id of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k_id, (one, two) = unpack(batch["k_id"][i].as_py(), np.int64), _names(batch, i)
                by = np.lexsort((k_id, two, one))
                k_id, one, two = k_id[by], one[by], two[by]
                at = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
                columns = [np.full(len(at), batch["block"][i].as_py()), one[at].view(np.int64), two[at].view(np.int64), k_id[at], np.diff(np.append(at, len(k_id)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "h1", "h2", "low", "n"])

    rows = blocks.select("block", "k_id", "names").mapInArrow(run, "block long, h1 long, h2 long, low long, n long")
    heads = rows.groupBy("h1", "h2").agg(F.min("low").alias("head"), F.sum("n").alias("n")).filter("n > 1").select("h1", "h2", "head")
    return materialize(rows.join(heads, ["h1", "h2"]).groupBy("block").agg(F.collect_list(F.struct("h1", "h2", "head")).alias("heads")))


def _names(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return unpack(batch["names"][i].as_py(), U64).reshape(-1, 2).T


def copies(batch: pa.RecordBatch, i: int, k_id: np.ndarray) -> np.ndarray:
    """Which documents of the block in a row of a batch (with names and heads) are copies of one with a smaller id."""
    heads = {(h["h1"], h["h2"]): h["head"] for h in batch["heads"][i].as_py() or ()}
    if not heads:
        return np.zeros(len(k_id), dtype=bool)
    one, two = _names(batch, i).view(np.int64).tolist()
    return np.array([heads.get((a, b), k) < k for a, b, k in zip(one, two, k_id.tolist(), strict=True)], dtype=bool)


def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """k_id, k_th and texts of the block in a row of a batch."""
    at = lambda c: batch[c][i].as_py()
    offsets, data = unpack(at("ends"), np.int64), stretch(at("z"))
    texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return unpack(at("k_id"), np.int64), unpack(at("k_th"), np.int64), texts


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each range, one range after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width consecutive values, where its least is (the first of equal ones)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = []
    for lo in range(0, n, _CHUNK):
        part = values[lo : min(len(values), lo + _CHUNK + width - 1)]
        low = (part & ~_AT) | np.arange(len(part), dtype=U64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = width - size
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        out.append((low[: min(n - lo, _CHUNK)] & _AT).astype(np.int64) + lo)
    return np.concatenate(out)


def runs_of_windows(grams: np.ndarray, room: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for each anchor: grams has the hash of the gram at each symbol, room how many
    symbols its document has from there."""
    place = least_places(grams, window - gram + 1)
    start = np.flatnonzero(room[: len(place)] >= window)
    anchor = place[start]
    if not len(start):
        return start, start, start
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    at = np.flatnonzero(new)
    return anchor[at], start[at], start[np.concatenate([at[1:] - 1, [len(start) - 1]])]


def cut_hash(values: np.ndarray) -> np.ndarray:
    return mix(values) >> U64(64 - BITS)


def repeated_anchors(blocks: DataFrame, anchors: Callable[[pa.RecordBatch, int], np.ndarray], per_byte: float, hot: int) -> tuple[DataFrame, np.uint64, bool]:
    """(block, answers, hot), the shift that makes a hash's range, and whether any anchor is hot. answers: for each range two
    packed bit arrays over the block's distinct sorted anchors of the range: which occur twice or more, and which of
    those more than hot times; hot: whether the block has any of the latter. anchors: the hashes of the block in a row of a batch."""
    total = blocks.agg(F.sum("size")).first()[0] or 0
    width = max(4, int(np.ceil(np.log2(max(1.0, total * per_byte / RANGE)))))
    shift = U64(BITS - width)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values, counts = np.unique(cut_hash(anchors(batch, i)), return_counts=True)
                part = (values >> shift).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
                stop = np.append(edge, len(part))[1:]
                packed = [pack(values[a:b]) for a, b in zip(edge, stop, strict=True)]
                times = [pack(np.minimum(counts[a:b], 1 << 30).astype(np.int32)) for a, b in zip(edge, stop, strict=True)]
                columns = [pa.array([batch["block"][i].as_py()] * len(packed), pa.int64()), pa.array(part[edge], pa.int64()), pa.array(packed, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "packed", "times"])

    def answer(table: pa.Table) -> pa.Table:
        own = [unpack(x.as_py(), U64) for x in table["packed"]]
        times = np.concatenate([unpack(x.as_py(), np.int32) for x in table["times"]])
        values, inverse = np.unique(np.concatenate(own), return_inverse=True)
        count = np.bincount(inverse, weights=times, minlength=len(values))
        twice, often = (count > 1)[inverse], (count > hot)[inverse]
        ends = np.cumsum([len(x) for x in own])
        bits = [squeeze(np.packbits(np.stack([twice[e - len(x) : e], often[e - len(x) : e]])).tobytes()) for x, e in zip(own, ends, strict=True)]
        some = [bool(often[e - len(x) : e].any()) for x, e in zip(own, ends, strict=True)]
        give_back()
        return pa.table({"block": table["block"].combine_chunks(), "part": table["part"].combine_chunks(), "bits": pa.array(bits, pa.binary()), "hot": pa.array(some)})

    sent = blocks.mapInArrow(send, "block long, part long, packed binary, times binary")
    answers = sent.groupBy("part").applyInArrow(answer, "block long, part long, bits binary, hot boolean")
    by_block = materialize(answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("answers"), F.max("hot").alias("hot")))
    return by_block, shift, not by_block.filter("hot").isEmpty()


def chosen(values: np.ndarray, answers: list[dict] | None, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Which of a block's anchors (hashes in its own order) occur twice or more, and which of those are hot."""
    distinct, inverse = np.unique(cut_hash(values), return_inverse=True)
    twice, often = np.zeros(len(distinct), dtype=bool), np.zeros(len(distinct), dtype=bool)
    part = (distinct >> shift).astype(np.int64)
    for a in answers or ():
        lo, hi = np.searchsorted(part, [a["part"], a["part"] + 1])
        bits = np.unpackbits(np.frombuffer(stretch(a["bits"]), dtype=np.uint8), count=2 * (hi - lo)).astype(bool)
        twice[lo:hi], often[lo:hi] = bits[: hi - lo], bits[hi - lo :]
    return twice[inverse], often[inverse]


def span_table(block: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Spans packed by block."""
    give_back()  # this is the last step of a group
    if len(block):
        by = np.lexsort((start, doc, block))  # overlapping spans of a document as one
        block, doc, start, end = block[by], doc[by], start[by], end[by]
        place = (np.cumsum(np.concatenate([[0], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])]))).astype(np.int64) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + place)
        new = np.concatenate([[True], (start + place)[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        block, doc, start, end = block[at], doc[at], start[at], (reach - place)[np.append(at, len(new))[1:] - 1]
    order = np.arange(len(block))
    ids, at = np.unique(block, return_index=True)
    stop = np.append(at, len(order))[1:]
    packed = [pack(np.concatenate([x[order[a:b]] for x in (doc, start, end)]).astype(np.int64)) for a, b in zip(at, stop, strict=True)]
    return pa.table({"block": pa.array(ids, pa.int64()), "spans": pa.array(packed, pa.binary())})


def hot_rows(later: np.ndarray, start: np.ndarray, window: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's windows as rows: those that are not later ones with their columns and start, the spans of the later ones in one row."""
    names, kinds = [*columns, "start", "spans"], [pa.int64()] * (len(columns) + 1) + [pa.binary()]
    first = [*(c[~later] for c in columns.values()), start[~later]]
    yield pa.RecordBatch.from_arrays([*map(pa.array, first), pa.nulls(len(first[0]), pa.binary())], names)
    if later.any():
        table = span_table(columns["block"][later], columns["doc"][later], start[later], start[later] + window)
        row = {"block": table["block"][0].as_py(), "spans": table["spans"][0].as_py()}
        yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(names, kinds, strict=True)], names)


def coverage(packed: list[bytes], first: np.ndarray, total: int) -> np.ndarray:
    """Which symbols of a block the spans cover; a span's places count from its document's first symbol."""
    change = np.zeros(total + 1, dtype=np.int64)
    for data in packed or ():
        doc, start, end = unpack(data, np.int64).reshape(3, -1)
        np.add.at(change, first[doc] + start, 1)
        np.add.at(change, first[doc] + end, -1)
    return np.cumsum(change)[:total] > 0
