"""Reproducible random choices: orders by md5 of keys, which DuckDB computes alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 3407


def hash_order(*columns: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def uniform(*columns: str, seed: int = SEED) -> Column:
    """A reproducible number from 0 to 1 for each row: the first 8 hexadecimal digits of the order key."""
    return F.conv(F.substring(hash_order(*columns, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def first_by_hash(rows: DataFrame, order: Column, n: Column) -> DataFrame:
    """The rows with the ``n`` smallest orders of each country (ties by id). ``n`` may use the rows' columns.

    Ranks come from the counts of 4,096 hash ranges and ranks within a range, so no country is sorted in one task.
    """
    keyed = rows.withColumn("order_", order).withColumn("range_", F.substring("order_", 1, 3))
    sizes = keyed.groupBy("country", "range_").agg(F.count("*").alias("n_"))
    ahead = Window.partitionBy("country").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("country", "range_", F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("ahead_"))
    # ranges that begin beyond n fall out before any row is ranked
    near = keyed.join(sizes, ["country", "range_"]).filter(F.col("ahead_") < n)
    nth = F.row_number().over(Window.partitionBy("country", "range_").orderBy("order_", "id"))
    return near.withColumn("nth_", nth + F.col("ahead_")).filter(F.col("nth_") <= n).drop("order_", "range_", "ahead_", "nth_")
