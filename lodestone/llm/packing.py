"""Packing by power-of-two decomposition: every document's ids are cut into pieces whose lengths are powers of two,
pieces of one length form a bucket, and each piece is a sequence of its own.

No sequence crosses documents and none is padded: a document of L ids gives L // 2048 pieces of 2048 ids, then one
piece for each bit of the rest, longest first. One map pass without a shuffle; sequence numbers are unique and come
from the task's number and the row's place in it.

Null or empty text: the closing id alone, one piece. Repeated rows are packed each. A null id stays null. An empty
table gives an empty result. The text of a special token counts as ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import chars_hash, slices

END_ID = 1
MOST = 2048
#: Bytes of text that are encoded at once: the larger, the fewer distinct pretokens are looked up again.
ENCODED_BYTES = 2_000_000
#: Pretokens whose ids a worker keeps between slices, twice over.
CACHED = 300_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"

#: Texts with other characters are left to the tokenizer itself, whose Unicode tables may be of another version.
_WIDE = re.compile("[^\x00-\x1b\x20-\x84\x86-\u024f]")
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_encoders: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    """The class of each character that is not wide."""
    import regex

    kinds = [(_LETTER, regex.compile(r"\p{L}")), (_NUMBER, regex.compile(r"\p{N}")), (_SPACE, regex.compile(r"\s"))]
    return np.array([next((k for k, x in kinds if x.match(chr(c))), _OTHER) for c in range(0x250)], dtype=np.uint8)


def pretoken_starts(chars: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pretokens of texts begin (chars: the texts' characters, one after the other): runs of letters, numbers,
    others and white space; of white space before something else the last character stands apart, and a blank joins what
    follows; an apostrophe that begins a pretoken takes an English ending with it."""
    n = len(chars)
    kind = classes[chars]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    edge = begins.copy()  # of documents
    begins[1:n] |= kind[1:] != kind[:-1]
    runs = begins.copy()
    after_space = np.flatnonzero(begins[1:n] & ~edge[1:n] & (kind[:-1] == _SPACE)) + 1
    begins[after_space - 1] = True
    begins[after_space[chars[after_space - 1] == 0x20]] = False
    mark = np.flatnonzero((chars == 0x27) & begins[:n] & runs[:n] & runs[1 : n + 1] & ~edge[1 : n + 1])
    if len(mark):
        padded = np.concatenate([chars, np.zeros(3, dtype=chars.dtype)])
        stop = offsets[np.searchsorted(offsets, mark, "right")]
        one, two = padded[mark + 1], np.where(mark + 2 < stop, padded[mark + 2], 0)
        pair = np.isin(one * 0x10000 + two, [ord(x) * 0x10000 + ord(y) for x, y in ("re", "ve", "ll")])
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, np.where(pair, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        begins[mark + 1] = False
        begins[mark + 1 + size] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    """Ids of texts. A byte-level BPE never merges across pretokens, so the ids of each pretoken are kept by its hash and
    only new ones reach the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.classes = _classes()
        self.kept: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}  # of the last CACHED before these; what is used again moves over

    def whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), 10_000):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 10_000], add_special_tokens=False)]
        return out

    def pretokens(self, names: list[str]) -> list[bytes]:
        """Ids of pretokens, many at a time: those with a blank before them follow each other in one text, those that
        begin with something else stand between line feeds; both texts split into just these pretokens again."""
        out: list[bytes] = [b""] * len(names)
        blank, bare, rest = [], [], []
        for i, x in enumerate(names):
            if x[0] == " ":
                (rest if len(x) == 1 or x[1].isspace() else blank).append(i)
            else:
                (rest if x[0].isspace() else bare).append(i)
        for which, before in ((blank, ""), (bare, "\n")):
            for lo in range(0, len(which), 4000):
                own = which[lo : lo + 4000]
                found = self.tokenizer.encode(before + before.join(names[i] for i in own), add_special_tokens=False)
                ids, words = np.array(found.ids, dtype="<u4"), np.array(found.word_ids, dtype=np.int64)
                if before:  # every other pretoken is a line feed
                    ids, words = ids[words % 2 == 1], words[words % 2 == 1] // 2
                edge = np.searchsorted(words, np.arange(len(own) + 1))
                if len(words) == 0 or words[-1] != len(own) - 1 or (np.diff(edge) < 1).any():
                    rest += own  # this tokenizer splits the joined text in another way: one at a time
                    continue
                data = ids.tobytes()
                for i, a, b in zip(own, (4 * edge[:-1]).tolist(), (4 * edge[1:]).tolist(), strict=True):
                    out[i] = data[a:b]
        for i, x in zip(rest, self.whole([names[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        wide = [i for i, t in enumerate(texts) if _WIDE.search(t)]
        plain = list(texts)
        for i in wide:
            plain[i] = ""
        joined = "".join(plain)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        start = pretoken_starts(chars, offsets, self.classes) if len(chars) else np.zeros(0, dtype=np.int64)
        end = np.append(start, len(chars))[1:]
        names, head, which = np.unique(chars_hash(chars, start, end), return_index=True, return_inverse=True)
        if len(self.kept) > CACHED:
            self.kept, self.older = {}, self.kept
        keys = names.tolist()
        ids = list(map(self.kept.get, keys))
        for i in [i for i, x in enumerate(ids) if x is None and keys[i] in self.older]:
            ids[i] = self.kept[keys[i]] = self.older[keys[i]]
        new = [i for i, x in enumerate(ids) if x is None]
        heads = head[new] if new else head[:0]
        found = self.pretokens([joined[a:b] for a, b in zip(start[heads].tolist(), end[heads].tolist(), strict=True)])
        for i, x in zip(new, found, strict=True):
            ids[i] = x
            self.kept[keys[i]] = x
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        own = size[which]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[which], own)
        total = np.concatenate([[0], np.cumsum(own)])[np.searchsorted(start, offsets)] * 4
        data = flat[at].tobytes()
        out = [data[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
        for i, x in zip(wide, self.whole([texts[i] for i in wide]), strict=True):
            out[i] = x
        return out


def cuts(total: int, most: int = MOST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of total ids: powers of two, longest first."""
    out, at = [], 0
    while at < total:
        size = min(most, 1 << ((total - at).bit_length() - 1))
        out.append((at, size))
        at += size
    return out


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, most: int = MOST, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, ids (unsigned 32-bit, little-endian), bucket (log2 of
    the length), sequence_id, offset."""
    path = path or tokenizer_path()
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, most=ENCODED_BYTES):
                doc, start, length, tokens, ids = [], [], [], [], []
                for d, own in zip(part["doc_id"].to_pylist(), encoder.encode([t or "" for t in part["text"].to_pylist()]), strict=True):
                    own += end
                    n = len(own) // 4
                    own_cuts = cuts(n, most)
                    doc += [d] * len(own_cuts)
                    tokens += [n] * len(own_cuts)
                    for at, size in own_cuts:
                        start.append(at)
                        length.append(size)
                        ids.append(own[4 * at : 4 * (at + size)])
                longs = [pa.array(x, pa.int64()) for x in (doc, start, length, tokens)]
                yield pa.RecordBatch.from_arrays([*longs, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return cut.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
