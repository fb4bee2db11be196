"""Class-based language model: base statistics against a plain version, gain on held-out text."""

import collections
import math
import re
import zlib

import numpy as np
from lodestone.llm import classlm


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: r for r in classlm.score(docs).collect()}
    cut = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in cut}
    c = collections.Counter(x for i, w in cut.items() if not held[i] for x in [*w, None])
    n, v = sum(c.values()), len(c)
    for i, w in cut.items():
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    own = [r for r in got.values() if r.held_out]
    assert len(own) > 100 and sum(r.score for r in own) > 0.97 * sum(r.base_score for r in own) > sum(r.base_score for r in own)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "a b", 1), (None, "a b", 1), (3, "B  a\nÄ", 1), (5, "x " * 5000, 1)], "doc_id long, text string, score int")
    got = classlm.score(docs, classes=3).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 4, 5001] and all(math.isfinite(r.score) for r in got)
    assert classlm.score(docs.limit(0)).count() == 0
    none = classlm.score(docs.filter("doc_id = 1"), folds=1, fold=0).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in none] == [(True, 0, 0)] * 2 and all(math.isfinite(r.score) for r in none)


def test_sweeps_raise_the_likelihood():
    rng = np.random.default_rng(0)
    of = np.concatenate([[0], 1 + rng.permutation(60) % 2])
    counts = np.zeros((61, 61))
    for _ in range(4000):  # words of the first half follow the second half and the other way round
        a = rng.integers(1, 31)
        b = rng.integers(31, 61)
        counts[a, b] += 1
        counts[b, rng.integers(1, 31)] += 1

    def vectors(of):
        side = np.eye(3)[of]
        return np.stack([counts.T @ side, counts @ side], axis=1)

    def value(of):
        m = np.zeros((3, 3))
        np.add.at(m, of, vectors(of)[:, 1, :])
        return classlm.likelihood(m)

    start = value(of)
    for turn in range(24):
        of = classlm.sweep(of, vectors(of), np.arange(1 + turn % 4, 61, 4))
    assert value(of) > start and len(set(of[1:31])) == len(set(of[31:])) == 1 and of[1] != of[31]
