"""Stratified and uniform samples, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.sources.records import id_list


def match_bucket(n: Column) -> Column:
    return F.when(n == 0, "singleton").when(n == 1, "1_match").when(n <= 5, "2-5_matches").otherwise("6+_matches")


def with_stratum(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Truth rows with country, match_count, match_bucket and stratum; ids without a record are dropped."""
    countries = records.select(F.col("entity_id").alias("source1_entity_id"), "country")
    n = F.size(id_list(F.col("matched_entity_ids")))
    out = truth.join(countries, "source1_entity_id").withColumn("match_count", n)
    out = out.withColumn("match_bucket", match_bucket(F.col("match_count")))
    return out.withColumn("stratum", F.concat_ws("_", "country", "match_bucket"))


def order_key(id_col: str, seed: int) -> Column:
    """Decides who is drawn: both engines have md5."""
    return F.md5(F.concat(F.col(id_col), F.lit(str(seed))))


def stratified_split(rows: DataFrame, size: int, seed: int = 42, id_col: str = "source1_entity_id") -> DataFrame:
    """`size` rows with every stratum's share rounded half to even, then trimmed or
    filled in the same order to exactly `size`.

    Who can be drawn is narrowed by counts of the order's first four digits, so
    only about `size` rows are sorted, however large a stratum is."""
    keyed = rows.withColumn("_o", order_key(id_col, seed)).withColumn("_p", F.substring("_o", 1, 4))
    counts = keyed.groupBy("stratum", "_p").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_total"))
    wanted = counts.groupBy("stratum").agg(F.sum("_c").alias("_n")).crossJoin(total)  # total is one row
    wanted = wanted.select("stratum", F.bround(F.col("_n") * (F.lit(float(size)) / F.col("_total"))).cast("long").alias("_want"))
    up = Window.partitionBy("stratum").orderBy("_p")
    before = (F.sum("_c").over(up) - F.col("_c")).alias("_before")  # at most 65536 rows a stratum
    reach = counts.select("stratum", "_p", before).join(wanted, "stratum").filter("_before < _want").select("stratum", "_p", "_want")
    near = keyed.join(reach, ["stratum", "_p"])
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("_o", id_col))
    drawn = near.withColumn("_r", rank).filter("_r <= _want").drop("_r", "_want")
    trimmed = drawn.orderBy("_o", id_col).limit(size)
    rest = keyed.join(trimmed.select(id_col), id_col, "left_anti").orderBy("_o", id_col).limit(size)
    both = trimmed.withColumn("_side", F.lit(0)).unionByName(rest.withColumn("_side", F.lit(1)))
    return both.orderBy("_side", "_o", id_col).limit(size).drop("_side", "_o", "_p")


def uniform_sample(rows: DataFrame, n: int, seed: int = 42, id_col: str = "entity_id") -> DataFrame:
    """n rows in the order of a hash of their id."""
    return rows.withColumn("_o", order_key(id_col, seed)).orderBy("_o", id_col).limit(n).drop("_o")


def first_per_country(rows: DataFrame, n: int, id_col: str = "source1_entity_id") -> DataFrame:
    """The first n rows of every country by id (the limit is pushed below the shuffle)."""
    place = F.row_number().over(Window.partitionBy("country").orderBy(id_col))
    return rows.withColumn("_r", place).filter(F.col("_r") <= n).drop("_r")


def only_ids(rows: DataFrame, ids: DataFrame, id_col: str = "entity_id", other: str = "source1_entity_id") -> DataFrame:
    return rows.join(ids.select(F.col(other).alias(id_col)), id_col, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str = "entity_id", other: str = "source1_entity_id") -> DataFrame:
    return rows.join(ids.select(F.col(other).alias(id_col)), id_col, "left_anti")
