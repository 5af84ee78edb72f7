"""Problem 2: what changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.columns import pick


def hash_number(col) -> F.Column:
    """Hex text as a number in canonical writing: case, stray blanks and leading zeros do not count; blank is null."""
    t = F.lower(F.trim(col))
    return F.when(F.length(t) > 0, F.regexp_replace(t, "^0+(?=.)", ""))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, isgl1_key, change_kind) per key that was added, removed or changed against the snapshot before.

    Snapshots that exist are numbered without gaps; each key is windowed by that index. A gap before a row is an
    addition, a gap after it a removal at the next snapshot, a differing known hash of the neighbour a change.
    Per snapshot and trimmed key the row with the latest delivered_at counts; among equal times a known hash wins over
    a null, then the greater. The first snapshot has none before it, so its keys are no additions. Null keys or numbers
    are ignored; an empty table gives an empty result; extra columns are ignored. Deliveries are pre-aggregated before
    the shuffle, so a key repeated in a third of all rows leaves one row per task and snapshot.
    """
    snapshots = pick(snapshots, "snapshot_no", "isgl1_key", "content_hash", "delivered_at")
    rows = snapshots.select(F.col("snapshot_no").cast("int").alias("no"), F.trim("isgl1_key").alias("key"), "delivered_at", hash_number(F.col("content_hash")).alias("h")).filter("no is not null and key is not null")
    once = rows.groupBy("key", "no").agg(F.max(F.struct("delivered_at", "h")).alias("m")).select("key", "no", F.col("m.h").alias("h"))
    series = snapshots.select(F.col("snapshot_no").cast("int").alias("no")).filter("no is not null").groupBy("no").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy(F.lit(1)).orderBy("no")  # one row per snapshot
    series = series.select("no", F.row_number().over(ordered).alias("idx"), F.lead("no").over(ordered).alias("next_no"))
    w = Window.partitionBy("key").orderBy("no")
    seen = once.join(series, "no").select("key", "no", "idx", "next_no", "h", F.lag("idx").over(w).alias("p_idx"), F.lag("h").over(w).alias("p_h"), F.lead("idx").over(w).alias("n_idx"))
    follows = F.col("p_idx") == F.col("idx") - 1
    here = F.when((F.col("idx") > 1) & ~F.coalesce(follows, F.lit(False)), "added").when(follows & (F.col("h") != F.col("p_h")), "changed")
    gone = F.when(F.col("next_no").isNotNull() & ~F.coalesce(F.col("n_idx") == F.col("idx") + 1, F.lit(False)), "removed")
    both = F.array(F.struct(F.col("no").alias("snapshot_no"), here.alias("change_kind")), F.struct(F.col("next_no").alias("snapshot_no"), gone.alias("change_kind")))
    return seen.select(F.col("key").alias("isgl1_key"), F.explode(both).alias("c")).select("c.snapshot_no", "isgl1_key", "c.change_kind").filter("change_kind is not null")
