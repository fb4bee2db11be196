"""The pipeline against a plain version, stage by stage."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from lodestone.llm import packing, quality

DATA = "/root/testdata/sf0.001"


def words(t):
    return (t or "").encode().split()


def plain_near(rows):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i or not sets[i]]


def plain_strip(rows):
    seen, out = set(), []
    for d, t in rows:
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone |= set(range(s, s + 20))
            seen.add(key)
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t))
    return out


def plain_clean(rows, items):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in items:
        w = find(t)
        k = min(10, len(w))
        windows |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1) if k}
    sizes = {len(x) for x in windows}
    return [(d, t) for d, t in rows if not any(tuple(w[a : a + k]) in windows for w in [find(t)] for k in sizes for a in range(len(w) - k + 1))]


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r.doc_id for r in quality.assess(docs, model).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    rows = plain_clean(plain_strip(plain_near(rows)), [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    encoder = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for d, t in rows:
        ids = [*encoder.encode(t, add_special_tokens=False).ids, 1]
        for at, size in packing.cuts(len(ids)):
            want[d, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)] += 1
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and 0 < len(rows) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 10, "label") for i in range(20)] + [(None, None, None, None, None, None), (3, "", "en", "s", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, k_label string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert out.filter("doc_id IS NOT NULL AND text <> ''").count() == 20
    assert len(corpus_pipeline.STAGES) == 5
