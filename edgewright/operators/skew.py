"""Joins and ordered windows that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys are counted by this many hash buckets, so the counting shuffle is bounded whatever the number of keys.
BUCKETS = 65_536
#: A bucket is hot when it holds at least this share of the rows: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: A hot bucket is spread into parts of about this many rows, of which there are SALTS at least and MOST_SALTS at most.
ROWS_PER_SALT, SALTS, MOST_SALTS = 2_000_000, 32, 4096


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, key: str, share: float = HOT_SHARE) -> dict[int, int]:
    """Hash buckets of `key` that hold at least `share` of the rows, with the number of parts each is to be spread into by
    its size; at most 1/share pairs of integers reach the driver.

    A null key has its own bucket. An empty table has no hot bucket.
    """
    counts = df.select(bucket_of(key).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # at most BUCKETS rows
    hot = counts.withColumn("total", total).filter((F.col("n") >= F.col("total") * share) & (F.col("n") > 1000))
    return {b: min(MOST_SALTS, max(SALTS, -(-n // ROWS_PER_SALT))) for b, n in hot.select("b", "n").collect()}


def salted(left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Add a `_salt` column to both sides for an equi join on (key, _salt).

    Rows of `left` in a hot bucket are spread over its parts by the hash of `spread_by`; the matching rows of
    `right`, of which there should be few per key, are repeated for each part. All other rows keep salt 0.
    The result of an inner, left, semi or anti join on (key, _salt) equals that on key alone.
    """
    hot = hot_buckets(left, key) if hot is None else hot
    if not hot:
        return left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), bucket_of(key)), F.lit(1))
    spread = F.pmod(F.xxhash64(F.lit("salt"), F.col(spread_by)), parts).cast("int")
    return left.withColumn("_salt", spread), right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))


def spread_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: dict[int, int] | None = None, how: str = "inner") -> DataFrame:
    """left join right on key, hot keys of `left` spread; `right` has few rows per key."""
    hot = hot_buckets(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    a, b = salted(left, right, key, spread_by, hot)
    return a.join(b, [key, "_salt"], how).drop("_salt")
