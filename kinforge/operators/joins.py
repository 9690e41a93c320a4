"""Joins that stay even when a key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(large: DataFrame, summed: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a table that is an aggregate by the same columns.

    Spark would reuse the aggregate's partitioning for the join, and a join
    without a shuffle of its own on both sides cannot be split when a key is
    hot.  A struct of the columns as the key asks for those shuffles; adaptive
    execution then splits the large side's hot partitions (the aggregate has one
    row a key, which costs little to send again)."""
    key = F.struct(*(F.col(c) for c in on))
    name = "_split_key"
    return large.withColumn(name, key).join(summed.withColumn(name, key).drop(*on), name).drop(name)
