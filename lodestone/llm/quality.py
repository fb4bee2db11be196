"""Quality rules: fixed rules over document statistics, then gradient-boosted trees for the verdict.

The trees are fitted on the driver from a bounded sample of labelled rows (``max_labels``), with monotonic
constraints on the statistics whose direction is known, and flattened into numpy node arrays. Scoring is one map
pass over all rows: no shuffle, nothing collected.

Null or empty text: all statistics 0, so the rules reject it (fewer than 50 words). Repeated rows are scored each.
Labels with a null id or quality are not learned from; without two classes of labels the verdict is the rules' alone.
An empty table gives an empty result. A very long text is a slice of its own. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import Words, mix, rolling, slices, spans_hash

U64 = np.uint64
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Name of each statistic that the trees see, and the sign that quality may take along it (0: free).
FEATURES = {
    "n_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1, "upper_share": -1,
    "digit_share": 0, "mark_share": -1, "unique_word_share": 0, "words_per_line": 0, "above_ascii_share": 0, "longest_word": 0,
}
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, dtype=np.int64) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[list(b"!?~^=+_")] = 1
_LEAD = np.ones(256, dtype=np.int64)
_LEAD[0x80:0xC0] = 0
_HIGH = np.zeros(256, dtype=np.int64)
_HIGH[0xC0:] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics of each text, and the matrix of FEATURES."""
    w = Words(column)
    n, h, doc = len(w), w.hashes(), w.doc_of_word()
    base = {"n_words": w.count.astype(np.int64), "word_chars": _sums(w.inside * _LEAD[w.data], w.offsets), "n_symbols": _sums(_SYMBOL[w.data], w.offsets)}

    salt = mix(doc.astype(U64) + U64(1))
    windows = rolling(h, 3)
    ok = np.flatnonzero(w.room()[: len(windows)] >= 3)
    hit = np.zeros(len(h) + 1, dtype=np.int64)
    if len(ok):
        _, inverse, count = np.unique(windows[ok] ^ salt[ok], return_inverse=True, return_counts=True)
        twice = ok[count[inverse] > 1]
        for k in range(3):
            hit[twice + k] = 1
    base["n_repeat_words"] = _sums(hit[:-1], w.first)

    feeds = np.flatnonzero(w.data == 10)
    line_start = np.unique(np.concatenate([w.offsets[:-1][np.diff(w.offsets) > 0], feeds + 1]))
    line_start = line_start[line_start < len(w.data)]
    line_doc = np.searchsorted(w.offsets, line_start, "right") - 1
    bound = np.concatenate([line_start[1:], [len(w.data)]]).astype(np.int64) if len(line_start) else line_start
    line_end = np.minimum(bound, w.offsets[line_doc + 1]) if len(line_start) else line_start
    if len(line_start):
        closed = (line_end > line_start) & (w.data[line_end - 1] == 10)
        line_end = line_end - closed
        wordy = np.searchsorted(w.start, line_start) < np.searchsorted(w.start, line_end)
        line_start, line_end, line_doc = line_start[wordy], line_end[wordy], line_doc[wordy]
    lines = np.bincount(line_doc, minlength=n).astype(np.int64)
    key = spans_hash(w.data, line_start, line_end) ^ mix(line_doc.astype(U64) + U64(1))
    _, at = np.unique(key, return_index=True)
    base["n_dup_lines"] = lines - np.bincount(line_doc[at], minlength=n)

    size = np.maximum(np.diff(w.offsets), 1)
    words = np.maximum(w.count, 1)
    _, at = np.unique(h ^ salt, return_index=True)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, doc, w.end - w.start)
    share = lambda table: _sums(table[w.data], w.offsets) / size
    columns = [
        base["n_words"], base["word_chars"] / words, base["n_symbols"] / size, base["n_dup_lines"] / np.maximum(lines, 1), base["n_repeat_words"] / words, share(_UPPER),
        share(_DIGIT), share(_MARK), np.bincount(doc[at], minlength=n) / words, w.count / np.maximum(lines, 1), share(_HIGH), longest,
    ]
    return base, np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """All trees flattened: node i splits on feature[i] at threshold[i] (left if at most that); leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int
    cut: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f >= 0, down, node)
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = tuple(FEATURES.values()), trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 5.0, keep_share: float = 0.999) -> Trees:
    """Logistic boosting over quantile bins. A split on a constrained feature must order its children's values, and
    bounds handed down keep every descendant on its side, so the whole model is monotonic along that feature.
    cut: 0.5, or lower where keep_share of the good rows would otherwise not be kept."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = node()
        G, H = g[rows].sum(), h[rows].sum()
        value[me] = rate * float(np.clip(-G / (H + penalty), low, high))
        if level == depth or len(rows) < 40:
            return me
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gl, hl = (np.cumsum(np.bincount(b, weights=v[rows], minlength=len(e) + 1))[:-1] for v in (g, h))
            vl, vr = (np.clip(-a / (c + penalty), low, high) for a, c in ((gl, hl), (G - gl, H - hl)))
            gain = gl**2 / (hl + penalty) + (G - gl) ** 2 / (H - hl + penalty) - G**2 / (H + penalty)
            gain[(hl < 1) | (H - hl < 1) | (signs[f] * (vr - vl) < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1] is None:
            return me
        f, k, vl, vr = best[1]
        mid = (vl + vr) / 2
        lo, hi = ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid)) if signs[f] < 0 else ((low, high), (low, high))
        goes = binned[rows, f] <= k
        feature[me], threshold[me] = f, float(edges[f][k])
        left[me] = grow(rows[goes], g, h, level + 1, *lo)
        right[me] = grow(rows[~goes], g, h, level + 1, *hi)
        return me

    model = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(feature)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        one = Trees(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array([first]), 0.0, depth, 0.5)
        margin += one.margin(x)
    model = Trees(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array(roots, dtype=np.int64), bias, depth, 0.5)
    good = model.score(x[y > 0.5])
    model.cut = float(min(0.5, np.quantile(good, 1 - keep_share)))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            _, x = statistics(part["text"])
            yield pa.RecordBatch.from_arrays([part["quality"], part["doc_id"], pa.array(list(x), pa.list_(pa.float64()))], ["quality", "doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Trees | None:
    """Fits the trees on at most max_labels labelled documents, those first in the order of a hash of their ids; of rows that share
    an id one is learned from, that with the least hash of its text. Without labels of both classes there is no model."""
    some = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(some), "doc_id")  # at most max_labels short rows are broadcast
    once = joined.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = once.select("quality", "doc_id", "text").mapInArrow(_features, "quality int, doc_id long, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    y = np.array([float(r["quality"] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r["x"] for r in rows]), y)


def assess(docs: DataFrame, model: Trees | None) -> DataFrame:
    """doc_id, the base statistics, base_failed, score (null without a model) and kept, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                base, x = statistics(part["text"])
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                score = model.score(x) if model else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(base[c]) for c in _BASE), pa.array(failed), pa.array(score) if model else pa.nulls(len(x), pa.float64()), pa.array(~failed & (score >= (model.cut if model else 0)))], names)

    names = ["doc_id", *_BASE, "base_failed", "score", "kept"]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The rows of docs, with all their columns, whose verdict is to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                base, x = statistics(part["text"])
                ok = (base["n_words"] >= MIN_WORDS) & (100 * base["n_repeat_words"] <= MAX_REPEAT_PERCENT * base["n_words"])
                if model:
                    ok &= model.score(x) >= model.cut
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
