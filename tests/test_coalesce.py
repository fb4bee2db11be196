"""Batches of file events against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import coalesce

KIND = "source string, t long, overflow boolean"


def plain(rows, width, limit):
    out = []
    for source in {r[0] for r in rows}:
        start = None
        for _, t, over in sorted((r for r in rows if r[0] == source and r[1] is not None), key=lambda r: r[1]):
            if start is None or t >= start + width:
                start = t
                out.append([source, t, 0, False])
            out[-1][2] += 1
            out[-1][3] = out[-1][3] or bool(over)
    return sorted(((s, t, n, o or n >= limit) for s, t, n, o in out), key=str)


def log(seed, n, span):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(-span, span) if rng.random() < 0.98 else None, rng.choice([False, False, None, True])) for _ in range(n)]
    return rows + rows[: n // 10]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_micros("t"))


def got(df):
    return sorted(((r.source, r.t, r.n, r.overflow) for r in df.withColumn("t", F.unix_micros("batch_ts")).collect()), key=str)


@pytest.mark.parametrize("seed,n,span,stretch", [(1, 400, 30_000, 1), (2, 400, 30_000, 2), (3, 600, 8_000, 3), (4, 50, 4_000_000, 2), (5, 300, 100_000, 512), (6, 0, 10, 2)])
def test_batches_of_a_log(spark, monkeypatch, seed, n, span, stretch):
    monkeypatch.setattr(coalesce, "STRETCH", stretch)
    rows = log(seed, n, span)
    assert got(coalesce.coalesced(frame(spark, rows), window_ms=1, limit=4)) == plain(rows, 1000, 4)


@pytest.mark.parametrize("seed,n,span,slices,block,steps", [(1, 400, 30_000, 64, 16, 2), (2, 600, 3_000, 64, 8, 1), (3, 600, 8_000, 4, 50, 3), (4, 900, 2_500, 2000, 1, 2), (5, 300, 100_000, 8, 20, 128)])
def test_batches_of_a_crowded_log(spark, monkeypatch, seed, n, span, slices, block, steps):
    for name, value in {"SLICES": slices, "BLOCK": block, "STEPS": steps}.items():
        monkeypatch.setattr(coalesce, name, value)
    rows = log(seed, n, span)
    assert got(coalesce.coalesced(frame(spark, rows), window_ms=1, limit=4)) == plain(rows, 1000, 4)


def test_no_task_folds_a_whole_crowded_range(spark, monkeypatch):
    def bounded(make):
        def made(width):
            run = make(width)

            def checked(key, table, *more):
                assert len(table) <= 128, len(table)
                return run(key, table, *more)

            return checked if make.__name__ == "_exits" else lambda key, table, more: checked(key, table, more)

        return made

    for name, value in {"BLOCK": 100, "SLICES": 64}.items():
        monkeypatch.setattr(coalesce, name, value, raising=False)
    monkeypatch.setattr(coalesce, "_exits", bounded(coalesce._exits))
    monkeypatch.setattr(coalesce, "_batches", bounded(coalesce._batches))
    # 12 windows of 1,000 times in one range
    rows = [("a", t, False) for t in range(0, 12_000)]
    assert got(coalesce.coalesced(frame(spark, rows), window_ms=1, limit=4)) == plain(rows, 1000, 4)


def test_batches_of_a_stream(spark, tmp_path):
    rows = sorted(((s, t + 10**10, o) for s, t, o in log(7, 300, 2_000_000) if t is not None), key=lambda r: r[1])
    folder = str(tmp_path / "in")
    for i in range(4):
        frame(spark, rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]).coalesce(1).write.mode("append").parquet(folder)
    # a last event far ahead moves the watermark over every open batch; its own stays open
    frame(spark, [("z", 2 * 10**10, False)]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(KIND + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    out = coalesce.coalesced_stream(stream, window_ms=50, limit=9, watermark="1 second")
    run = out.writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert got(spark.table("batches")) == plain(rows, 50_000, 9)
