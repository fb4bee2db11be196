"""File events: filters, debouncing, overflow, and the merge of a batch into the index (coalesce has the batches).

Each rule exists twice: over a finished log as window expressions (replay, tests), and over a stream. The stream keeps
one short session for each path and a watermark only to bound that state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEBOUNCE_MS, COALESCE_MS, OVERFLOW = 200, 2000, 400


def wanted(events: DataFrame, include: list[str], exclude: list[str], skip_dirs: tuple[str, ...] = (".git",), max_bytes: int | None = None) -> DataFrame:
    """Events of paths outside skipped folders, not excluded, included, and not too large unless removed. Overflow
    markers pass. include and exclude: regular expressions (see expr.glob_to_regex)."""
    hit = lambda rx: F.col("path").rlike("|".join(f"(?:{r})" for r in rx)) if rx else F.lit(False)
    ok = ~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(d) for d in skip_dirs))) & ~hit(exclude) & hit(include)
    if max_bytes is not None:
        ok = ok & (F.col("removed") | (F.coalesce("size", F.lit(0)) <= max_bytes))
    return events.filter(F.col("overflow") | ok)


def debounced(events: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(path, first_ts, last_ts, n, removed): events of a path that follow each other within the quiet time are one; the
    last one's flag counts. events: path, ts, seq, removed."""
    w = Window.partitionBy("path").orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    g = events.withColumn("new", F.coalesce(gap > quiet_ms * 1000, F.lit(True)).cast("int")).withColumn("burst", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("path", "burst").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("removed", F.struct("ts", "seq")).alias("removed")).drop("burst")


def debounced_stream(events: DataFrame, quiet_ms: int = DEBOUNCE_MS, watermark: str = "10 seconds") -> DataFrame:
    s = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", f"{quiet_ms} milliseconds").alias("w"), "path")
    return s.agg(F.count("*").alias("n"), F.max_by("removed", F.struct("ts", "seq")).alias("removed")).select("path", F.col("w.start").alias("first_ts"), "n", "removed")


def actions(batch: DataFrame, limit: int = OVERFLOW) -> DataFrame:
    """What a micro-batch asks for: one row for each path (its last event), or a single rescan."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("seq"))
    last = batch.withColumn("k", F.row_number().over(w)).filter("k = 1")
    total = batch.agg(F.count("*").alias("n"), F.coalesce(F.max("overflow"), F.lit(False)).alias("over")).withColumn("rescan", (F.col("n") >= limit) | F.col("over"))
    one = total.filter("rescan").select(F.lit("rescan").alias("action"), F.lit(None).cast("string").alias("path"))
    each = last.crossJoin(F.broadcast(total.select("rescan"))).filter("NOT rescan").select(F.when(F.col("removed"), "delete").otherwise("process").alias("action"), "path")  # a single row
    return each.unionByName(one)


def start_merge(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, limit: int = OVERFLOW):
    """Feeds each micro-batch's actions to apply(actions, batch_id), which may run again for the same batch."""
    return events.writeStream.foreachBatch(lambda df, i: apply(actions(df, limit), i)).option("checkpointLocation", checkpoint).outputMode("append").start()


def telemetry_stream(spark, folder: str) -> DataFrame:
    schema = "ts timestamp, tool string, in_bytes long, out_bytes long, dur_ms long, ok boolean, sid string, kind string, _corrupt_record string"
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)
