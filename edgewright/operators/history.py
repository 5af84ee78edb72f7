"""Problem 4: the full history of changing attributes, by presence bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.columns import pick
from edgewright.operators.skew import bucket_of, hot_buckets

STATE = ["current_ind", "future_ind", "future_action", "birth_timestamp"]


def state_versions(states: DataFrame) -> DataFrame:
    """(isgl1_key, the four attributes, valid_from, valid_to) per longest stretch of equal states; the last is open (null).

    Each moment of a key is a bit. Per key and state the bits are gathered into 64-bit words; a run of set bits is a
    version, and a run that reaches a word's edge goes on in the next word. Per key and effective_at the report with
    the latest received_at counts, then the greatest report_id. Null is a value like any other. Rows without key or
    effective_at are ignored; an empty table gives an empty result; extra columns are ignored.

    Rows are partitioned by key once, which serves every step after it. Keys in buckets that hold a large share of the
    rows are split by day instead: moments are numbered per key and day and the days offset by a running sum, so no task
    sorts all moments of such a key; a word holds at most 64 moments.
    """
    states = pick(states, "report_id", "isgl1_key", *STATE, "effective_at", "received_at")
    rows = states.filter("isgl1_key is not null and effective_at is not null").select(F.col("isgl1_key").alias("key"), F.col("effective_at").alias("at"), "received_at", "report_id", F.struct(*STATE).alias("state"))
    hot = list(hot_buckets(rows, "key"))
    found = _by_key(rows.filter(~bucket_of("key").isin(hot)) if hot else rows)
    if hot:
        found = found.unionByName(_by_day(rows.filter(bucket_of("key").isin(hot))))
    return found.select(F.col("key").alias("isgl1_key"), "state.*", F.col("at").alias("valid_from"), F.col("next_at").alias("valid_to"))


def _once(rows: DataFrame) -> DataFrame:
    """(key, at, state): the report that counts for each moment."""
    return rows.groupBy("key", "at").agg(F.max_by("state", F.struct("received_at", "report_id")).alias("state"))


def _runs(bits: DataFrame) -> DataFrame:
    """(key, state, at): the first moments of the runs of set bits."""
    words = bits.groupBy("key", "state", F.expr("bit div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("present"),
        F.collect_list(F.struct(F.expr("cast(bit % 64 as int)").alias("b"), "at")).alias("moments"),
    )
    carry = F.lag(F.struct("word", "present")).over(Window.partitionBy("key", "state").orderBy("word"))
    into: Column = F.coalesce(F.when((carry["word"] == F.col("word") - 1) & (carry["present"] < 0), F.lit(1)), F.lit(0))
    # a bit starts a run when the bit below it, or the top bit of the word before, is not set
    starts = words.withColumn("starts", F.col("present").bitwiseAND(F.bitwise_not(F.expr("shiftleft(present, 1)").bitwiseOR(into.cast("long")))))
    return starts.select("key", "state", F.explode(F.expr("filter(moments, m -> (shiftrightunsigned(starts, m.b) & 1) = 1)")).alias("m")).select("key", "state", "m.at")


def _by_key(rows: DataFrame) -> DataFrame:
    """(key, state, at, next_at), all moments of a key in one partition."""
    of_key = Window.partitionBy("key").orderBy("at")
    once = _once(rows.repartition(F.col("key")))
    runs = _runs(once.withColumn("bit", F.row_number().over(of_key) - 1))
    return runs.withColumn("next_at", F.lead("at").over(of_key))


def _by_day(rows: DataFrame) -> DataFrame:
    """The same for keys with any number of moments, a day of a key at a time."""
    once = _once(rows).withColumn("day", F.to_date("at"))
    local = once.withColumn("i", F.row_number().over(Window.partitionBy("key", "day").orderBy("at")))
    days = once.groupBy("key", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("key", "day", F.coalesce(before, F.lit(0)).alias("before"))
    bits = local.join(days, ["key", "day"]).withColumn("bit", F.col("before") + F.col("i") - 1)
    # the next version of a key begins at the next run start of any state; ordered per key, day by day
    runs = _runs(bits).withColumn("block", F.to_date("at"))
    in_block = F.lead("at").over(Window.partitionBy("key", "block").orderBy("at"))
    firsts = runs.groupBy("key", "block").agg(F.min("at").alias("first_at"))
    firsts = firsts.select("key", "block", F.lead("first_at").over(Window.partitionBy("key").orderBy("block")).alias("next_first"))
    out = runs.withColumn("in_block", in_block).join(firsts, ["key", "block"])
    return out.select("key", "state", "at", F.coalesce("in_block", "next_first").alias("next_at"))
