"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

Sketch: in round i every shingle of a document falls into one of t bins by hash and a bin keeps the least (round, hash)
it saw; rounds go on until all bins are full, and from round t on all shingles fall into bin i - t, so that every
coordinate fills. Values of later rounds never displace earlier ones, so a document of n shingles needs about
t ln t / n rounds, and the number of equal coordinates is concentrated as that of t independent ones.

Documents with the same shingles are one class. Classes that share a band of the sketch are candidates, and every link
is confirmed on the full sets. No bucket emits its pairs: its members are compared with the one that shares most
bands with others, as the original of edited copies does. Where a bucket still holds several components, its members'
sets meet in groups of a bounded size, and every member outside the largest component is held against all others
there; a group emits one link for a member and another component, so rows stay in proportion to the members.
With 48 bands of 6 rows a pair of similarity 0.8 shares no band with probability 5e-7; nothing else loses a link.

Null or empty text: no shingles, linked with nothing, kept. A text of fewer words than a shingle is one shingle.
Repeated rows are one class. A null id comes first among a class's rows but is no component_id where another id is
in reach; alone it gets component_id null and is kept. A very long text is a slice of its own, with one sketch as any
other. An empty table gives an empty result. Other columns may have any names: ``deduplicate`` carries them in one struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.storage import materialize
from lodestone.llm.text import NULL_ID, Words, keyed, keyed_struct, mix, rolling, slices

U64 = np.uint64
WORDS, PERCENT = 5, 80
BANDS, ROWS = 48, 6
_SHIFT = U64(46)
_MASK = U64((1 << 46) - 1)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: Shingles that a group of a bucket's members is to hold, and by how many 32 bits of hashes may miscount a pair's.
GROUP, SLACK = 2_000_000, 2


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each document."""
    h = w.hashes()
    windows, out = rolling(h, k), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        else:
            out.append(rolling(h[a:b], b - a) ^ mix(np.array([b - a], dtype=U64)) if b > a else h[:0])
    return out


def sketch(s: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    out = np.full(t, _EMPTY, dtype=U64)
    at, step = 0, int(min(t, max(1, np.ceil(t * np.log(t) / len(s)))))
    while at < t:
        rounds = np.arange(at, min(t, at + step))
        x = mix(s[None, :] ^ seeds[rounds][:, None])
        bins = ((x >> U64(32)) * U64(t)) >> U64(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds.astype(U64) << _SHIFT)[:, None] | (mix(x) & _MASK)).ravel())
        if (out != _EMPTY).all():
            return out
        at += step
    for j in np.flatnonzero(out == _EMPTY):
        out[j] = (U64(t + j) << _SHIFT) | (mix(s ^ seeds[t + j]) & _MASK).min()
    return out


def _sketches(k: int, bands: int, rows: int):
    t = bands * rows
    schema = pa.schema([("k_id", pa.int64()), ("k_th", pa.int64()), ("n_shingles", pa.int64()), ("set", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, 2 * t + 1, dtype=U64) * U64(0xA0761D6478BD642F))
        weight = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(Words(part["text"], lower=True), k)
                named = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                drawn = [sketch(s, t, seeds) if len(s) else None for s in sets]
                own = [None if x is None else mix((x.reshape(bands, rows) * weight).sum(axis=1, dtype=U64) ^ mix(np.arange(bands, dtype=U64))).view(np.int64) for x in drawn]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(named, pa.binary()), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["k_id"], part["k_th"], *columns], schema=schema)

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b"):
                one, two = (shingle_sets(Words(part[c], lower=True), k) for c in ("text_a", "text_b"))
                ok = []
                for s, t in zip(one, two, strict=True):
                    if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                        ok.append(False)
                        continue
                    both = np.concatenate([s, t])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * same >= percent * (len(both) - same))
                yield pa.RecordBatch.from_arrays([part["a"], part["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def texts_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of some classes."""
    need = classes.select("node", "rep.k_id", "rep.k_th").join(nodes, "node", "left_semi")
    return rows.join(need, ["k_id", "k_th"]).select("node", "text").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs(a, b) of classes whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = texts_of(nodes, classes, rows)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "a long, b long")


def _short_sets(k: int):
    """(node, n, s): the 32-bit hashes of each class's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique((s >> U64(32)).astype(np.uint32)) for s in shingle_sets(Words(part["text"], lower=True), k)]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "s"])

    return run


def _across(percent: int):
    """Links between components among the members of one group: of each member outside the largest component, to each other
    component its most similar member if that is surely a link, else all that may be one."""

    def run(table: pa.Table) -> pa.Table:
        node, root = table["node"].to_numpy(), table["root"].to_numpy()
        sets = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table["s"]]
        size = np.array([len(x) for x in sets])
        _, every = np.unique(np.concatenate(sets), return_inverse=True)
        first, mark = np.cumsum(size) - size, np.zeros(int(every.max()) + 1, dtype=np.int32)
        roots, own, count = np.unique(root, return_inverse=True, return_counts=True)
        links = []
        for x in np.flatnonzero(own != count.argmax()).tolist():
            mine = every[first[x] : first[x] + size[x]]
            mark[mine] = 1
            shared = np.add.reduceat(mark[every], first)
            mark[mine] = 0
            near = lambda i, d: 100 * (shared[i] + d) >= percent * (size[i] + size[x] - shared[i] - d)
            others = np.flatnonzero((own != own[x]) & near(slice(None), SLACK))
            for r in np.unique(own[others]):
                y = others[own[others] == r]
                best = y[np.argmax(shared[y] / (size[y] + size[x] - shared[y]))]
                links += [(x, z) for z in ([best] if near(best, -SLACK) else y)]
        a, b = (node[np.array([l[i] for l in links], dtype=np.int64)] for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def across_components(placed: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): probable links between components of buckets; placed: band, node, root. A bucket of more than GROUP shingles is
    cut into parts by node, and any two parts are a group."""
    spread = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    left = materialize(placed.join(spread, "band"))
    sets = materialize(texts_of(left.select("node"), classes, rows).mapInArrow(_short_sets(k), "node long, n long, s binary"))
    sized = left.join(sets.select("node", "n"), "node").groupBy("band").agg(F.ceil(F.sum("n") / (GROUP // 2)).alias("parts"))
    dealt = left.join(sized, "band").withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("band", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets.select("node", "s"), "node").groupBy("band", "i", "j").applyInArrow(_across(percent), "a long, b long")


def classify(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """For each row: k_id, k_th, n_shingles, root (a number of its component) and component (the least id in reach; null: none)."""
    rows = keyed(docs)
    signed = materialize(rows.mapInArrow(_sketches(k, bands, band_rows), "k_id long, k_th long, n_shingles long, set binary, bands array<long>"))
    least = F.min(F.when(F.col("k_id") != NULL_ID, F.col("k_id"))).alias("least")
    classes = signed.filter("set IS NOT NULL").groupBy("set").agg(F.min(F.struct("k_id", "k_th", "bands")).alias("rep"), least)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    members = classes.select("node", F.explode("rep.bands").alias("band"))

    shared = materialize(members.join(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "band"))
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    pivots = shared.join(weight, "node").groupBy("band").agg(F.max(F.struct("w", "node")).alias("p")).select("band", F.col("p.node").alias("p"))
    tested = materialize(shared.join(pivots, "band").filter("node <> p").select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct())
    roots = components(materialize(confirmed(tested, classes, rows, k, percent)))

    placed = shared.filter("n > 2").join(roots, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root"))
    new = materialize(across_components(placed, classes, rows, k, percent).distinct())
    if not new.isEmpty():
        links = confirmed(new, classes, rows, k, percent).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(materialize(links))
    rooted = classes.join(roots, "node", "left").select("set", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("set", "component", "root")
    own = F.when(F.col("k_id") != NULL_ID, F.col("k_id"))
    return signed.drop("bands").join(named, "set", "left").select("k_id", "k_th", "n_shingles", "root", F.when(F.col("set").isNull(), own).otherwise(F.col("component")).alias("component"))


def report(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    out = classify(docs, k, percent).withColumn("doc_id", F.when(F.col("k_id") != NULL_ID, F.col("k_id")))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with its least id, with all columns of docs; rows without shingles all stay."""
    own = F.when(F.col("k_id") != NULL_ID, F.col("k_id"))
    kept = classify(docs, k, percent).filter(own.eqNullSafe(F.col("component"))).groupBy("k_id", "k_th").agg(F.max("n_shingles").alias("k_n"), F.max("root").alias("k_root"))
    tagged = keyed_struct(docs).join(kept, ["k_id", "k_th"])
    # of rows that repeat id and text, and of texts of one id that are near-duplicates of each other, one stays
    empty, full = tagged.filter("k_n = 0"), tagged.filter("k_n > 0")
    out = full.dropDuplicates(["k_id", "k_root"]).unionByName(empty)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


def sql() -> str:
    """The same in DuckDB's SQL, with all pairs of documents that share a shingle."""
    return r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT r, doc_id, w, unnest(CASE WHEN len(w) >= 2 THEN range(1, len(w)) WHEN len(w) = 1 THEN [0] ELSE [] END) AS i FROM d),
s AS (SELECT DISTINCT r, doc_id, CASE WHEN i = 0 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM e),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT r AS x, r AS y FROM d UNION SELECT c.x, u.y FROM c JOIN u ON c.y = u.x),
m AS (SELECT c.x AS r, min(d.doc_id) AS component_id FROM c JOIN d ON c.y = d.r GROUP BY c.x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN m USING (r)"""
