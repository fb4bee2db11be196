"""Batches of file events: one opens at its first event and takes what comes within the window; one of ``limit`` events or
more, or with a backend's overflow, is a single marker. Over a finished log and over a stream.

events: source, ts, overflow. Rows without a time open no batch and go; a null source is a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.streaming.watch import COALESCE_MS, OVERFLOW

#: A range of the log, in windows. A range of more than BLOCK events is cut into blocks of up to BLOCK and those of one slice, a
#: window's SLICES-th part. STEPS: how many ends of a block go in one row.
STRETCH, SLICES, BLOCK, STEPS = 512, 64, 1 << 19, 128


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by("t")
    return table, table["t"].to_numpy()


def _exits(width: int):
    """For a block: when the last batch that opens in it ends, by the first event that opens one. A batch from before ends
    within a window of the block's first event, so only events up to there, or the first after, can be that event."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        source, part, block = (k.as_py() for k in key)
        _, t = _sorted(table)
        after = np.append(np.searchsorted(t, t + width), len(t))
        some = min(int(np.searchsorted(t, t[0] + width)) + 1, len(t))
        last, at = np.arange(some), np.arange(some)
        while (at < len(t)).any():
            last, at = np.where(at < len(t), at, last), after[at]
        ends = t[last] + width
        edge = np.append(ends[1:] != ends[:-1], True)
        upto, ends = t[:some][edge], ends[edge]
        rows = range(0, len(upto), STEPS)
        same = {"source": pa.array([source] * len(rows), pa.string()), "part": [part] * len(rows), "block": [block] * len(rows), "first": list(rows)}
        return pa.table(same | {"upto": [upto[i : i + STEPS] for i in rows], "ends": [ends[i : i + STEPS] for i in rows]})

    return run


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The end of the last batch before each block, from block to block; one batch of rows is held at a time."""
    none = np.iinfo(np.int64).min
    now, end, entered = None, none, False
    for batch in batches:
        out, (upto, ends) = [], (batch.column(c) for c in ("upto", "ends"))
        for i, place in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "part", "block")), strict=True)):
            if place != now:
                end = end if now is not None and place[0] == now[0] else none
                now, entered = place, False
                out.append((*place, end))
            if not entered:
                k = int(np.searchsorted(upto[i].values.to_numpy(), end))
                if k < len(upto[i]):
                    end, entered = ends[i][k].as_py(), True
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array([row[c] for row in out], kind) for c, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["source", "part", "block", "carried"])


def _batches(width: int):
    def run(key: tuple, events: pa.Table, carried: pa.Table) -> pa.Table:
        events, t = _sorted(events)
        before = carried["carried"][0].as_py()
        starts, at = [before - width] if before > t[0] else [], int(np.searchsorted(t, before))
        while at < len(t):
            starts.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + width))
        starts = np.array(starts, dtype=np.int64)
        which = np.searchsorted(starts, t, side="right") - 1
        first = np.flatnonzero(np.diff(which, prepend=-1))
        n = np.add.reduceat(events["n"].to_numpy(), first)
        over = np.maximum.reduceat(events["over"].to_numpy(zero_copy_only=False), first)
        return pa.table({"source": pa.array([key[0].as_py()] * len(first), pa.string()), "batch": starts[which[first]], "n": n, "over": over})

    return run


def _blocks(timed: DataFrame, width: int) -> DataFrame:
    """(source, part, block, t, n, over): the distinct times of a log in ranges (part), and in blocks of a crowded range."""
    cell = F.floor(F.col("t") / max(width // SLICES, 1))
    timed = timed.withColumn("cell", cell).withColumn("part", F.floor(F.col("cell") / (SLICES * STRETCH)))
    before = Window.partitionBy("source", "part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = timed.groupBy("source", "part", "cell").agg(F.count("*").alias("n"))
    firsts = sizes.withColumn("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK)).groupBy("source", "part", "block").agg(F.min("cell").alias("cell"))
    # a row stands for a range of more than BLOCK events
    crowded = firsts.groupBy(F.col("source").alias("c_source"), F.col("part").alias("c_part")).agg(F.collect_list("cell").alias("firsts")).filter(F.size("firsts") > 1)
    times = timed.groupBy("source", "part", "cell", "t").agg(F.count("*").alias("n"), F.max("over").alias("over"))
    times = times.join(F.broadcast(crowded), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("part") == F.col("c_part")), "left")
    block = F.when(F.col("firsts").isNotNull(), F.size(F.filter("firsts", lambda x: x <= F.col("cell")))).otherwise(0).cast("long")
    return times.select("source", "part", block.alias("block"), "t", "n", "over")


def coalesced(events: DataFrame, window_ms: int = COALESCE_MS, limit: int = OVERFLOW) -> DataFrame:
    """(source, batch_ts, n, overflow) of a finished log.

    Where a batch ends depends on where the one before began. So a log is cut into blocks of time, each of which is folded for
    every event that may open its first batch; the ends are carried from block to block in one pass over these short rows,
    and the blocks are folded again from there. No task holds more than the times of a block, which are bounded however crowded a
    window is; the carrying task reads a source's ends in order and holds one batch of them."""
    width, keys = window_ms * 1000, ["source", "part", "block"]
    timed = events.filter("ts IS NOT NULL").select("source", F.unix_micros("ts").alias("t"), F.coalesce("overflow", F.lit(False)).alias("over"))
    times = _blocks(timed, width)
    exits = times.groupBy(*keys).applyInArrow(_exits(width), "source string, part long, block long, first long, upto array<long>, ends array<long>")
    carried = exits.repartition("source").sortWithinPartitions(*keys, "first").mapInArrow(_carry, "source string, part long, block long, carried long")
    out = times.groupBy(*keys).cogroup(carried.groupBy(*keys)).applyInArrow(_batches(width), "source string, batch long, n long, over boolean")
    out = out.groupBy("source", "batch").agg(F.sum("n").alias("n"), F.max("over").alias("over"))
    return out.select("source", F.timestamp_micros("batch").alias("batch_ts"), "n", ((F.col("n") >= limit) | F.col("over")).alias("overflow"))


def coalesced_stream(events: DataFrame, window_ms: int = COALESCE_MS, limit: int = OVERFLOW, watermark: str = "10 seconds") -> DataFrame:
    """The same over a stream: a batch closes at an event past its window, or when the watermark passes its end. Events
    of one micro-batch are taken in the order of time; one that comes later than its batch counts for the open one,
    and one behind the watermark goes. The state of a source is three numbers."""
    width = window_ms * 1000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, row = [], state.get if state.exists else None
        got = pd.concat(list(parts)).sort_values("t", kind="stable") if not state.hasTimedOut else None
        t, over = (got["t"].to_numpy(), got["over"].to_numpy()) if got is not None else (np.zeros(0, np.int64), np.zeros(0, bool))
        at = 0
        while at < len(t):
            if row is None:
                row = (int(t[at]), 0, False)
            to = int(np.searchsorted(t, row[0] + width))
            if to > at:
                row = (row[0], row[1] + to - at, row[2] or bool(over[at:to].any()))
                at = to
            if at < len(t):
                closed.append(row)
                row = None
        end = (row[0] + width) // 1000 if row else 0
        if row and (state.hasTimedOut or end <= state.getCurrentWatermarkMs()):
            closed.append(row)
            row = None
        if row:
            state.update(row)
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"source": [key[0]] * len(closed), "batch": [c[0] for c in closed], "n": [c[1] for c in closed], "over": [c[2] for c in closed]})

    timed = events.withWatermark("ts", watermark).filter("ts IS NOT NULL").select("source", "ts", F.unix_micros("ts").alias("t"), F.coalesce("overflow", F.lit(False)).alias("over"))
    kind, held = "source string, batch long, n long, over boolean", "start long, n long, over boolean"
    out = timed.groupBy("source").applyInPandasWithState(run, kind, held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("source", F.timestamp_micros("batch").alias("batch_ts"), "n", ((F.col("n") >= limit) | F.col("over")).alias("overflow"))
