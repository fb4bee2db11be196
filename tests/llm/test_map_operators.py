"""Operators of one map pass (quality, packing, decontamination) and sharding, against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lodestone.llm import decontam, licenses, packing, quality, sharding, urlfilter
from lodestone.llm.text import Words, rolling

DATA = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "a\n\na\n", "a b c a b c a b", "é é é é", "x" * 70_000, "GNU General Public License, mit license mit LICENSE. CC-BY"]


def texts():
    return pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()[:120] + ODD


def table(spark, rows, extra=False):
    rows = [(i, t) for i, t in enumerate(rows)] + [(3, "twice the same row"), (3, "twice the same row"), (None, "a row without an id")]
    if extra:
        return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, label string")
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_word_hashes_and_windows():
    w = Words(pa.array(["a b a b", "b a", None, ""]))
    h = w.hashes()
    assert w.count.tolist() == [4, 2, 0, 0] and h[0] == h[2] == h[5] and h[1] == h[4] != h[0]
    for n in (1, 2, 3, 10, 20):
        x = rolling(np.tile(np.arange(40, dtype=np.uint64), 2), n)
        assert len(x) == 81 - n and x[0] == x[40] and len(set(x[:40].tolist())) == 40


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_statistics():
    base, x = quality.statistics(pa.array(texts()))
    assert list(zip(*(base[c].tolist() for c in quality._BASE))) == [brute_statistics(t) for t in texts()]
    assert np.isfinite(x).all()


def test_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.3) & (rng.random(4000) < 0.95)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            line = np.repeat(x[:20], 50, axis=0)
            line[:, f] = np.tile(np.linspace(0, 1, 50), 20)
            steps = np.diff(model.margin(line).reshape(20, 50), axis=1)
            assert (sign * steps >= -1e-12).all()


def test_quality_query(spark):
    docs = table(spark, texts(), extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(130)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = quality.assess(docs, quality.train(docs, labels)).collect()
    assert len(got) == docs.count() and quality.keep_good(docs, None).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.assess(docs.limit(0), None).count() == 0


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = quality.assess(docs, quality.train(docs, learn)).join(held, "doc_id").select("kept", "quality", "base_failed").filter("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = table(spark, texts() + ["don't we'll 12 34  x \n\n y<|endoftext|>", "漢字 и text", "it's 'twas x's. 's 're're 'll'l l'\n's I'm'd''s a'", "  a   b\t c\n\nd \t e  ", " \xa0x\x85y\x1cz", "'s", "a'", "1'ds ²½"])
    rows = packing.digest(packing.pieces(docs)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    encoder = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    encoder.encode_special_tokens = True
    want = collections.Counter()
    for r in docs.collect():
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 1]
        at, n = 0, len(ids)
        while at < n:
            size = 2048 if n - at >= 2048 else 2 ** ((n - at).bit_length() - 1)
            want[r.doc_id, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), n] += 1
            at += size
    assert want == collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)


def brute_contamination(docs, items, n=10):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = find(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if own := windows.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= {str(i) for i in own if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [32_000_000, 3_000])
def test_decontamination(spark, block):
    read = lambda name, sf: pq.read_table(f"/root/testdata/{sf}/{name}.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in read("benchmark", "sf0.01")] + [(90, "Tiny item"), (91, None), (92, "..."), (None, "a row without an id"), (1, "another text of one")]
    docs = [(r["doc_id"], r["text"]) for r in read("documents", "sf0.01")][:500] + [(900 + i, t) for i, t in enumerate(ODD)] + [(5, "x tiny, ITEM y"), (5, "x tiny, ITEM y"), (None, "a row without an id")]
    got = decontam.digest(decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)).drop("longest").collect()
    want = brute_contamination(docs, items)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(r[5] for r in want)
    kept = decontam.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert kept.count() == sum(not r[5] for r in want)


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(5)
    for _ in range(30):
        sizes, capacity = [rng.randint(1, 60) for _ in range(rng.randint(0, 1500))], 100
        free, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
            b = min(fits)[1] if fits else len(free)
            if not fits:
                free.append(capacity)
            free[b] -= sizes[i]
            want[i] = b
        assert sharding.best_fit_decreasing(sizes, capacity) == [want[i] for i in range(len(sizes))]


@pytest.mark.parametrize("fineness", [50_000, 40])
def test_sharding(spark, fineness):
    docs = table(spark, texts() + ["the same"] * 300, extra=True)
    rows = sharding.shard(docs, fineness=fineness).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(8))
    assert len({(r.size, r.text_crc32) for r in rows}) == sum(len({(r.size, r.text_crc32) for r in x}) for x in by.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_runs_are_placed_as_their_items():
    rng = random.Random(6)
    for _ in range(30):
        runs = [(s, rng.randint(1, 40)) for s in rng.sample(range(1, 90), rng.randint(0, 60))]
        got = sharding.best_fit_runs(runs, 100)
        one_by_one = sharding.best_fit_decreasing([s for s, n in runs for _ in range(n)], 100)
        assert sorted((s, b) for (s, _), placed in zip(runs, got) for b, n in placed for _ in range(n)) == sorted(zip([s for s, n in runs for _ in range(n)], one_by_one))


def test_small_groups_are_packed_by_their_own_sizes(spark):
    docs = spark.createDataFrame([(i, f"{i:05}" + "x" * (994 if i % 2 else 2994)) for i in range(800)], "doc_id long, text string")
    sizes = [r[1] for r in sharding.shard(docs, fineness=40).groupBy("shard").sum("size").collect()]
    assert sizes == [200_000] * 8


def test_sharding_is_even(spark):
    rows = sharding.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in rows]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.001 * sum(sizes)


def test_licenses(spark):
    out = {r.n_words: r for r in licenses.scan(table(spark, ODD[-1:] + ["So: permission is hereby granted, free of charge, to any person obtaining a copy", "Licensed under CC BY-NC 4.0."], extra=True)).collect()}
    r = out[10]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 0, 8, "cc-by,gpl,mit") and r.score == 1
    assert out[7].labels == "cc-by,cc-by-nc-4.0-notice" and out[14].n_base == 0 and out[14].first_word is None
    empty = licenses.scan(spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")).collect()
    assert [(r.n_words, r.labels, r.score) for r in empty] == [(0, "", 0.0)] * 3


@pytest.mark.parametrize("odd", ["\u2028", "\u2029", "\x85"])
def test_last_phrase_behind_a_line_separator(spark, odd):
    r = licenses.scan(spark.createDataFrame([(1, f"a{odd} b MIT License c")], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (5, 1, 2, 2)


def test_url_filters_by_shuffle_as_by_broadcast(spark):
    pages = spark.createDataFrame([(i, u, f"2024-{1 + i % 12:02}-15") for i, u in enumerate(["http://a.b.org/x/y?z", "https://u@b.org:80/", "ftp://c.org", "none", None, "http://A.B.ORG/X"] * 12)], "page_id long, url string, fetched_on string")
    entries = spark.createDataFrame([("b.org", "block", "2024-03-01"), ("b.org", "allow", "2024-06-01"), ("a.b.org/x", "block", "2024-09-01"), ("b.org", "block", "2024-06-01"), (None, "block", "2024-01-01")], "pattern string, action string, listed_on string")
    one, two = (sorted(map(tuple, urlfilter.evaluate(pages, entries, broadcast_rows=n).collect()), key=str) for n in (100, 1))
    assert one == two and len(one) == 72
    # a.b.org/x is blocked from September, and only the last of every twelve captures fits it then
    assert sorted(r[0] for r in one if r[5]) == list(range(11, 72, 12))


@pytest.mark.parametrize("broadcast_rows", [100, 1])
def test_url_filters_by_entries_of_any_depth(spark, broadcast_rows):
    urls = ["http://h.org/a/b/c/d", "http://h.org/a/b/c/d/e/f?q", "http://h.org/a/b/c/dx", "http://h.org/a/b/c", "http://h.org/1/2/3/4/5/6/7", "http://h.org/1/2/3/4/5/6", "http://h.org/"]
    pages = spark.createDataFrame([(i, u, "2024-05-01") for i, u in enumerate(urls)], "page_id long, url string, fetched_on string")
    entries = [("h.org/a/b/c/d", "block"), ("h.org/a/b/c/d/e", "allow"), ("h.org/1/2/3/4/5/6/7", "block")]
    got = urlfilter.evaluate(pages, spark.createDataFrame([(*e, "2024-01-01") for e in entries], "pattern string, action string, listed_on string"), broadcast_rows=broadcast_rows)
    assert sorted((r.page_id, r.pattern, r.blocked) for r in got.collect() if r.pattern) == [(0, "h.org/a/b/c/d", True), (1, "h.org/a/b/c/d/e", False), (4, "h.org/1/2/3/4/5/6/7", True)]


def test_a_full_cache_of_pretokens(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    encoder = packing.Encoder(packing.tokenizer_path())
    for i in range(12):
        texts = [f"the word{k} it's  {k * k}\n\tend{i}" for k in range(i, i + 4)] + ["", " ", "the the end3"]
        assert encoder.encode(texts) == encoder.whole(texts)
        assert len(encoder.older) < 60
