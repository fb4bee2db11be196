"""Tables written in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which must be set: a folder of one machine would lose what other machines write."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set; name a folder there that the driver and all executors share")
    return folder


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _place(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """The rows of df, written once and read back: cuts the lineage, survives lost executors. The files go when the
    driver's process ends; the shuffle files of the job that made them go at once."""
    spark, path = df.sparkSession, _place(df.sparkSession)
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """As materialize, in as many buckets of a column as there are shuffle partitions: joins on it do not move these rows again."""
    spark, path = df.sparkSession, _place(df.sparkSession)
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lodestone_{uuid.uuid4().hex}"
    df.repartition(n, column).write.format("parquet").option("path", path).bucketBy(n, column).saveAsTable(name)
    del df
    release(spark)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs whose plans nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
