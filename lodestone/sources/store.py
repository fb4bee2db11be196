"""The index on shared storage: a full reconcile, single changes, and reading it back.

A version is a folder of Parquet tables; it counts from the moment its row is in the table ``versions``, so a job that
dies leaves the version before it in force and a repeated batch only writes the next one. What files yield (``rows``) is
kept as parsed: a reconcile parses only files whose content is new and links all of them again by joins, so its result is
that of a rebuild. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import tree
from lodestone.sources.extract import ROWS, extract
from lodestone.sources.model import DOCUMENTS, FILES, LINES, PROJECTS, REFS, SYMBOLS, Snapshot

TABLES = {"projects": PROJECTS, "files": FILES, "symbols": SYMBOLS, "refs": REFS, "documents": DOCUMENTS, "lines": LINES}
VERSIONS = "version long, last_full_scan_at long"
FACTS = ("path", "size_bytes", "mtime_ns", "content_hash")


def _path(spark: SparkSession, name: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, name: str) -> bool:
    fs, at = _path(spark, name)
    return fs.exists(at)


def newest(spark: SparkSession, folder: str) -> tuple[int, int | None] | None:
    """(version, last full scan) of the version in force; none before the first reconcile."""
    if not _exists(spark, f"{folder}/versions"):
        return None
    row = spark.read.schema(VERSIONS).parquet(f"{folder}/versions").agg(F.max_by(F.struct("version", "last_full_scan_at"), "version").alias("v")).first()
    return (row.v.version, row.v.last_full_scan_at) if row.v else None


def _table(spark: SparkSession, folder: str, version: int, name: str) -> DataFrame:
    return spark.read.schema(TABLES.get(name, ROWS)).parquet(f"{folder}/v{version}/{name}")


def read(spark: SparkSession, folder: str) -> Snapshot:
    got = newest(spark, folder)
    if got is None:
        raise FileNotFoundError(f"no index in {folder}")
    return Snapshot(*(_table(spark, folder, got[0], t) for t in TABLES), got[1])


def run_once(spark: SparkSession, root: str, folder: str, include: list[str], exclude: list[str], now: int, max_kb: int = 1024) -> Snapshot:
    """Full reconcile: walk, parse what is new, replace, prune what the walk did not see, link, stamp the scan."""
    return _commit(spark, folder, tree.walk(spark, root, include, exclude, max_kb), None, now, now)


def handle_changes(spark: SparkSession, root: str, folder: str, actions: DataFrame, include: list[str], exclude: list[str], now: int, max_kb: int = 1024) -> Snapshot:
    """The index after a batch of actions (action, path) as watch.actions gives them: named files are read again or go, a
    rescan is a full reconcile. A batch names fewer paths than the overflow limit. A path that is gone or that the globs
    leave out goes, whatever the action says; a path of no known type stays a file without symbols."""
    todo = {(r.action, r.path) for r in actions.select("action", "path").collect()}
    got = newest(spark, folder)
    if got is None or ("rescan", None) in todo:
        return run_once(spark, root, folder, include, exclude, now, max_kb)
    if not todo:
        return read(spark, folder)
    there = sorted(p for a, p in todo if a == "process" and _exists(spark, f"{root}/{p}"))
    walked = tree.walk(spark, root, include, exclude, max_kb, there)
    return _commit(spark, folder, walked, sorted({p for _, p in todo}), now, got[1])


def _commit(spark: SparkSession, folder: str, walked: DataFrame, named: list[str] | None, now: int, scanned: int | None) -> Snapshot:
    """Writes the next version. named: the paths that walked speaks for, all if none."""
    got = newest(spark, folder)
    version = got[0] + 1 if got else 1
    new = f"{folder}/v{version}"
    empty = lambda schema: spark.createDataFrame([], schema)
    old = {t: _table(spark, folder, got[0], t) if got else empty(TABLES.get(t, ROWS)) for t in (*TABLES, "rows")}
    seen = walked.join(old["files"].select("path", "content_hash", F.col("last_indexed_at").alias("since")), ["path", "content_hash"], "left")
    # Written first: the walk reads every file once, and what is kept is decided on one state of the tree.
    seen.write.mode("overwrite").parquet(f"{new}/walked")
    seen = spark.read.schema(seen.schema).parquet(f"{new}/walked")
    rest = old["files"].filter(~F.col("path").isin(named)) if named is not None else empty(FILES)
    same = seen.filter("since IS NOT NULL").select("path").unionByName(rest.select("path"))
    fresh = seen.filter("since IS NULL")
    rows = old["rows"].join(same, "path", "left_semi").unionByName(extract(fresh))
    rows.write.mode("overwrite").parquet(f"{new}/rows")
    lines = old["lines"].join(same, "path", "left_semi").unionByName(tree.lines_of(fresh))
    facts = seen.select(*FACTS, F.coalesce("since", F.lit(now)).cast("long").alias("last_indexed_at")).unionByName(rest.select(*FACTS, "last_indexed_at"))
    snap = tree.assemble(spark, facts, _table(spark, folder, version, "rows"), lines, scanned).with_(projects=old["projects"])
    for t, schema in TABLES.items():
        frame = getattr(snap, t)
        frame.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", "))).write.mode("overwrite").parquet(f"{new}/{t}")
    spark.createDataFrame([(version, scanned)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return read(spark, folder)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Removes versions older than the last few; readers of a removed version must read again."""
    got = newest(spark, folder)
    gone = []
    for v in range(got[0] - keep, 0, -1) if got else ():
        fs, at = _path(spark, f"{folder}/v{v}")
        if not fs.exists(at):
            break
        fs.delete(at, True)
        gone.append(v)
    return gone
