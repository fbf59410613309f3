"""Where shared files go, and how lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session; a folder of our own only where that is unset and everything runs in one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    found = context._jsc.sc().getCheckpointDir()
    if named is None and not found.isDefined() and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named is None:
        named = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="quarry-")
    if not found.isDefined():
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop deletes what is there when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files and checkpoints of finished rounds now, rather than when the driver happens to collect its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a Parquet table in the shared folder, and read again.

    For rows that several branches read and that are dear to compute.  The table stays
    until the application ends, as the result may be read at any later time.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_grouped(left: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Join with the groups of the keys on the keys and a hash bit of the first, so that the grouped side has an exchange of its own and hot keys can be split."""
    right = grouped.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = F.pmod(F.xxhash64(keys[0]), F.lit(2)) == F.pmod(F.xxhash64(f"r_{keys[0]}"), F.lit(2))
    for k in keys:
        on &= F.col(k) == F.col(f"r_{k}")
    return left.join(right, on).drop(*[f"r_{k}" for k in keys])


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Rows numbered from 0 in a global order, without gathering them in one task.

    Rows are dealt by ranges of the order and kept (cut), so that numbers and offsets come from the same
    partitions; only one count a partition reaches the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mono")))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_mono").alias("first")).orderBy("_part").collect()
    at, shifts = 0, {}
    for r in counts:
        shifts[r["_part"]] = at - r["first"]
        at += r["n"]
    if not shifts:
        return held.withColumn(name, F.lit(0).cast("bigint")).drop("_part", "_mono")
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(shifts.items()), "_part int, _shift bigint")  # one row a partition
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_mono") + F.col("_shift")).drop("_part", "_mono", "_shift")
