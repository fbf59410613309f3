"""Helpers shared by the operators, most of them the core library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.components import connected as connected_components
from quarry.operators.lineage import cut, join_grouped, release, shared_folder, written

__all__ = ["connected_components", "cut", "join_grouped", "most_frequent", "release", "shared_folder", "table", "written"]


def most_frequent(counted: DataFrame, limit: int, n: str = "n", key: str = "token") -> list:
    """The most frequent rows of a table of counts, about ``limit`` at most: whole frequency classes (2 % wide) from the top, and of the first class that does not fit the share that does, by a hash of the key.

    The driver receives one row a class and then the rows asked for; no task sends a list of its own.
    """
    counted = cut(counted.withColumn("_class", F.floor(F.log(n) * 50).cast("int")))
    sizes = sorted(((r["_class"], r["size"]) for r in counted.groupBy("_class").agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    held, lowest, share = 0, None, 0.0
    for c, size in sizes:
        lowest = c
        if held + size > limit:
            share = (limit - held) / size
            break
        held, share = held + size, 1.0
    if lowest is None:
        return []
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return counted.where((F.col("_class") > lowest) | ((F.col("_class") == lowest) & drawn)).drop("_class").collect()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
