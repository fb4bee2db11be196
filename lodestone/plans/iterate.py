"""Support for plans that loop on the driver."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the checkpoint folder, so that a loop's plan stays small and survives lost
    executors. Where spark.checkpoint.dir is unset, a single machine gets a folder of our own; a cluster is an error."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()
