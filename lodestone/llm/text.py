"""Vectorised byte-level views of Arrow string columns, shared by the Arrow-backed operators.

Everything here works on a whole Arrow slice at once with numpy: word boundaries, 64-bit word
hashes and rolling n-gram hashes never loop over words in Python.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)

#: Bytes of text handled at once; a longer document is handled alone and whole.
SLICE_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE_WORD = np.ones(256, dtype=bool)
_SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_ALNUM_WORD = np.zeros(256, dtype=bool)
_ALNUM_WORD[0x30:0x3A] = _ALNUM_WORD[0x61:0x7B] = _ALNUM_WORD[0x80:] = True
#: By name: the bytes of words. "space": all but white space; "alnum": digits, a-z and all above ASCII.
WORD_BYTES = {"space": _SPACE_WORD, "alnum": _ALNUM_WORD}

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to the slice size."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if size <= 2 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def sums_of(data: np.ndarray) -> np.ndarray:
    """What ``hash_between`` needs of data: sums over all of its prefixes."""
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(mix(np.arange(256, dtype=U64) + U64(1))[data] * powers(_BASE, len(data)), out=total[1:])
    return total


def hash_between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(_BASE_INVERSE, len(total))[start] + (end - start).astype(U64) * _STEP)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    return hash_between(sums_of(data), start, end)


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """spans_hash of data[i : i + n] at each of the len(data) - n + 1 starts."""
    if len(data) < n:
        return np.zeros(0, dtype=U64)
    total = sums_of(data)
    return mix((total[n:] - total[:-n]) * powers(_BASE_INVERSE, len(data) - n + 1) + np.array([n], dtype=U64) * _STEP)


def window_hashes_at(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The same at some starts, in parts of data, so that no array is much longer than a slice of texts."""
    out = np.empty(len(start), dtype=U64)
    by = np.argsort(start, kind="stable")
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], start[by] // SLICE_BYTES])))
    for a, b in zip(edge, np.append(edge, len(start))[1:], strict=True):
        own = by[a:b]
        lo, hi = start[own[0]], start[own[-1]] + n
        out[own] = spans_hash(data[lo:hi], start[own] - lo, start[own] - lo + n)
    return out


def chars_hash(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As spans_hash, of arrays of small numbers such as characters."""
    n = len(chars)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(mix(chars.astype(U64) + U64(1)) * powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(_BASE_INVERSE, n + 1)[start] + (end - start).astype(U64) * _STEP)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values, at each of the len(h) - n + 1 starts."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    out, done = None, 0
    block, size = h, 1
    while n:
        if n & 1:
            part = block[done : len(block)] if done else block
            if out is None:
                out = part
            else:
                m = min(len(out), len(part))
                out = out[:m] * powers_of(size) + part[:m]
            done += size
        n >>= 1
        if n:
            block = block[: len(block) - size] * powers_of(size) + block[size:]
            size *= 2
    return mix(out)


def powers_of(k: int) -> np.uint64:
    return U64(pow(int(_STEP), k, 1 << 64))


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class Words:
    """Word boundaries and hashes of a column of texts.

    data: the bytes, lower-cased in A-Z if asked; offsets: of the documents in data; start, end: of each word;
    first: index of each document's first word, with a closing total.
    """

    def __init__(self, column: pa.Array, kind: str = "space", lower: bool = False):
        raw, self.offsets = binary_buffers(column)
        self.raw, self.data = raw, _LOWER[raw] if lower else raw
        self.inside = WORD_BYTES[kind][self.data]
        n = len(self.data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = self.inside[:-1]
            after = np.empty(n, dtype=bool)
            after[-1] = False
            after[:-1] = self.inside[1:]
            self.start = np.flatnonzero(self.inside & (~before | cut[:-1]))
            self.end = np.flatnonzero(self.inside & (~after | cut[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.count)

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


@functools.cache
def _trimmer() -> Callable[[int], int] | None:
    with contextlib.suppress(AttributeError, OSError):
        return ctypes.CDLL(None).malloc_trim
    return None


def give_back() -> None:
    """Returns freed memory to the system where the C library can: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trimmer():
        _trimmer()(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most so many bytes of text each, or one document."""
    at = batch.schema.get_field_index(column)
    _, offsets = binary_buffers(batch.column(at))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


#: What a null id counts as where ids are ordered: it comes before all others.
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """(k_id, k_th, text): the inner key of a row. Rows that repeat id and text share it and are one document;
    rows of one id with different texts are documents of their own, ordered by k_th; a null id comes first."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k_id"), F.xxhash64("text").alias("k_th"), "text")


def keyed_struct(docs: DataFrame) -> DataFrame:
    """(k_id, k_th, row): the inner key of each row and the row itself in one struct, whatever its columns are called."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k_id"), F.xxhash64("text").alias("k_th"), row)


def longs(values: np.ndarray) -> pa.Array:
    """An Arrow column of longs from unsigned or signed values."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == U64 else values.astype(np.int64))
