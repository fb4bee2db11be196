"""Verification of a change: removed symbols, dangling references, stale paths, tests to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.expr import dir_name, is_test_file
from lodestone.operators.graph import closure_files
from lodestone.sources.model import Snapshot


def removed_symbols(old: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of old (n, qualified, name, kind, old_path) whose qualified name is gone; the first of each name."""
    gone = old.join(current.select("qualified"), "qualified", "left_anti")
    w = Window.partitionBy("qualified").orderBy("n")
    return gone.withColumn("k", F.row_number().over(w)).filter("k = 1").select("qualified", "name", "kind", "old_path").orderBy("qualified")


def dangling_refs(snap: Snapshot, removed: DataFrame, changed_files: DataFrame) -> DataFrame:
    """References from unchanged files to what was removed: by full name (exact), else by short name where they reach no
    living symbol. A reference appears once, exact if it can."""
    r = snap.refs.filter("kind <> 'import'").join(changed_files.select(F.col("id").alias("src_file_id")), "src_file_id", "left_anti")
    exact = r.join(removed.select(F.col("qualified").alias("dst_name")).distinct(), "dst_name", "left_semi").withColumn("exact", F.lit(True))
    alive = snap.symbols.select(F.col("id").alias("dst_symbol_id"))
    short = r.join(removed.select(F.col("name").alias("dst_short")).distinct(), "dst_short", "left_semi").join(alive, "dst_symbol_id", "left_anti").withColumn("exact", F.lit(False))
    short = short.join(exact.select("id"), "id", "left_anti")
    files = snap.placed_files().select(F.col("id").alias("src_file_id"), F.col("shown").alias("src_path"))
    names = snap.symbols.select(F.col("id").alias("src_symbol_id"), F.col("qualified").alias("src_qualified"))
    both = exact.select(*snap.refs.columns, "exact").unionByName(short.select(*snap.refs.columns, "exact"))
    both = both.join(files, "src_file_id").join(names, "src_symbol_id", "left")
    return both.select("id", "src_path", F.coalesce("src_qualified", F.lit("")).alias("src_qualified"), "dst_name", "dst_short", "kind", "line", "exact")


def classify(removed: DataFrame, danglers: DataFrame, living_names: DataFrame) -> DataFrame:
    """(qualified, n_exact, n_short, level) of each removed symbol: fail with exact evidence, warn with short names only.
    A bare name that no living symbol has any more counts as exact; short evidence goes to all removed of that name."""
    gone = danglers.join(living_names.select(F.col("name").alias("dst_short")).distinct(), "dst_short", "left_anti").select(F.col("id").alias("g_id"))
    d = danglers.join(gone, F.col("id") == F.col("g_id"), "left").withColumn("bare_gone", F.col("g_id").isNotNull() & (F.col("dst_name") == F.col("dst_short")) & ~F.col("exact"))
    full = d.filter("exact").select(F.col("dst_name").alias("qualified"), F.lit(1).alias("e"), F.lit(0).alias("s"))
    loose = d.filter("NOT exact").join(removed.select("qualified", F.col("name").alias("r_name")), F.col("dst_short") == F.col("r_name")).select("qualified", F.col("bare_gone").cast("int").alias("e"), (~F.col("bare_gone")).cast("int").alias("s"))
    n = full.unionByName(loose).groupBy("qualified").agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    out = removed.join(n, "qualified", "left").select("qualified", "kind", F.coalesce("e", F.lit(0)).cast("long").alias("n_exact"), F.coalesce("s", F.lit(0)).cast("long").alias("n_short"))
    return out.withColumn("level", F.when(F.col("n_exact") > 0, "fail").when(F.col("n_short") > 0, "warn").otherwise("pass"))


def verdict(classified: DataFrame) -> DataFrame:
    """One row: level, removed, exact, short."""
    worst = F.coalesce(F.max(F.when(F.col("level") == "fail", 2).when(F.col("level") == "warn", 1).otherwise(0)), F.lit(0))
    return classified.agg(F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("level"), F.count("*").alias("removed"), F.coalesce(F.sum("n_exact"), F.lit(0)).alias("exact"), F.coalesce(F.sum("n_short"), F.lit(0)).alias("short"))


def stale_changed(changed: DataFrame, files: DataFrame, walked: DataFrame) -> DataFrame:
    """(path, state) of changed paths that make the index stale: missing on disk, modified, parseable but unindexed."""
    f, w = files.select("path", F.col("mtime_ns").alias("i")), walked.select("path", F.col("mtime_ns").alias("w"), "parseable")
    both = changed.select("path").distinct().join(f, "path", "left").join(w, "path", "left")
    state = F.when(F.col("i").isNotNull() & F.col("w").isNull(), "missing").when(F.col("i") != F.col("w"), "modified").when(F.col("i").isNull() & F.coalesce("parseable", F.lit(False)), "unindexed")
    return both.select("path", state.alias("state")).filter("state IS NOT NULL")


def select_tests(snap: Snapshot, changed_files: DataFrame, depth: int = 5, project: str | None = None) -> DataFrame:
    """(path, project, distance): test files that are changed (0) or reach a changed file's symbols."""
    seeds = snap.symbols.join(changed_files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    own = snap.placed_files(project).join(changed_files.select("id"), "id", "left_semi").select(F.col("shown").alias("path"), "project", F.lit(0).alias("distance"))
    every = closure_files(snap, seeds, depth, project).unionByName(own).groupBy("path", "project").agg(F.min("distance").alias("distance"))
    return every.filter(is_test_file(F.col("path"))).orderBy("distance", "path")


def test_dirs(tests: DataFrame) -> DataFrame:
    return tests.select(F.when(dir_name(F.col("path")) == ".", F.lit(".")).otherwise(F.concat(F.lit("./"), dir_name(F.col("path")))).alias("dir")).distinct().orderBy("dir")
