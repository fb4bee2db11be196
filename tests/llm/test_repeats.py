"""Near-duplicates and repeats against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from lodestone.llm import minhash, substring, suffixes
from lodestone.llm.components import components


def repeated_texts(n=60, seed=3, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [[rng.choice(words) for _ in range(rng.randint(18, 70))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        out.append((" " if rng.random() < 0.5 else "\n").join(w))
    return [*out, *out[:5], "", None, " ", "a b a b", " ".join(["la"] * 100), " ".join(["la"] * 30), "É" * 9 + " é"]


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "x", 1), (7, texts[7], "x", 1), (8, texts[9], "x", 1), (None, texts[2], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, block int")


def places(docs):
    """Rows as documents: one for each id and text, in the operator's order."""
    return sorted(docs, key=lambda r: (r.k_id, r.k_th))


def brute_words(rows, window):
    seen, out = {}, {}
    for r in places(rows):
        key = (r.k_id, r.k_th)
        w = (r.text or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[s : s + window]), (key, s)) != (key, s):
                gone |= set(range(s, s + window))
        out[key] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return sorted(str((*out[r.k_id, r.k_th],)) for r in rows)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_substring_dedup(spark, hot):
    docs = frame(spark, repeated_texts())
    rows = minhash.keyed(docs).collect()
    got = substring.examine(docs, hot=hot, bin_size=20).collect()
    assert sorted(str((r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute_words(rows, 20)
    assert sum(r.n_removed > 0 for r in got) > 10
    kept = substring.strip(docs, hot=hot)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_substring_dedup_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = substring.report(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    seen, want = set(), {}
    for r in rows:
        w, gone = r.text.encode().split(), set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone |= set(range(s, s + 20))
            seen.add(key)
        want[r.doc_id] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert substring.report(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 660)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def brute_near(rows, k, percent):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(str((r.doc_id, len(s), least.get(find(i)), r.doc_id == least.get(find(i)))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(2)
    texts = repeated_texts(30)
    for t in texts[:12]:
        for share in (0.01, 0.02, 0.05, 0.1):
            w = (t or "").split()
            texts.append(" ".join(x.upper() if rng.random() > share else f"z{rng.randint(0, 9)}" for x in w))
    docs = frame(spark, texts)
    got = minhash.report(docs, k=k)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_near(docs.collect(), k, 80)
    kept = minhash.deduplicate(docs, k=k)
    assert kept.columns == docs.columns and kept.filter("trim(text) <> ''").count() == minhash.classify(docs, k=k).filter("n_shingles > 0").select("root").distinct().count()
    assert minhash.report(docs.limit(0)).count() == 0


def test_sql_of_near_duplicates_is_registered():
    assert "RECURSIVE" in minhash.sql()


def brute_bytes(rows, window=50):
    least = {}
    for r in rows:
        t = (r.text or "").encode()
        for s in range(len(t) - window + 1):
            w = t[s : s + window]
            least[w] = min(least.get(w, r.k_id), r.k_id)
    out = []
    for r in rows:
        t = (r.text or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - window + 1):
            if least[t[s : s + window]] < r.k_id:
                gone[s : s + window] = b"\1" * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, hot):
    docs = frame(spark, repeated_texts(40))
    got = suffixes.examine(docs, hot=hot, bin_bytes=3_000).collect()
    assert sorted(str((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == brute_bytes(minhash.keyed(docs).collect())
    assert sum(r.n_removed > 0 for r in got) > 10 and suffixes.report(docs.limit(0)).count() == 0


def test_merged_intervals_against_sorted_suffixes():
    rng = random.Random(4)
    shards = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 40))) for _ in range(12)}) for _ in range(4)]
    made = []
    for strings in shards:
        text = b"".join(s + b"\xff" for s in strings)
        made.append((text, *suffixes.shard_transform(np.frombuffer(text, dtype=np.uint8), np.array([len(s) + 1 for s in strings]))))
    interval = suffixes.merged_intervals([m[1] for m in made], 6).tolist()
    seen, at = {}, [(text, int(p)) for text, _, place in made for p in place]
    for (text, p), g in zip(at, interval, strict=True):
        prefix = text[p : p + 6]
        if b"\xff" not in prefix:
            assert seen.setdefault(g, prefix) == prefix
    by_interval = [seen[g] for g in sorted(seen)]
    assert by_interval == sorted(by_interval)
    assert len(set(seen.values())) == len(seen) > 40
