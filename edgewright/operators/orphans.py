"""Problem 1: references to records that do not exist at the time they are observed.

A reference is one side of an edge. Its key is compared exactly with the records that existed at observed_at:
placeholder records exist at all times, an entity from first_seen_at until removed_at. What has no record is a direct
orphan; the cascade then treats what refers to an orphaned record as indirectly orphaned, by semi joins down the
key graph until nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.columns import pick
from edgewright.operators.skew import hot_buckets, salted, spread_join
from edgewright.session import cut

#: What the key of a placeholder record looks like.
PLACEHOLDER = r":(unresolved-reference|external-dependency-[^:]*):0-0$"


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, side, key, observed_at): both references of every edge."""
    sides = F.array(
        F.struct(F.lit("from").alias("side"), F.col("from_key").alias("key")),
        F.struct(F.lit("to").alias("side"), F.col("to_key").alias("key")),
    )
    edges = pick(edges, "edge_id", "from_key", "to_key", "observed_at")
    return edges.select("edge_id", "observed_at", F.explode(sides).alias("r")).select("edge_id", "r.side", "r.key", "observed_at")


def lifetimes(entities: DataFrame, externals: DataFrame) -> DataFrame:
    """(key, begins, ends): distinct periods of existence; a null begin has always begun, a null end is open."""
    entities, externals = pick(entities, "isgl1_key", "first_seen_at", "removed_at"), pick(externals, "isgl1_key")
    own = entities.select(F.col("isgl1_key").alias("key"), F.col("first_seen_at").alias("begins"), F.col("removed_at").alias("ends"), F.lit(True).alias("dated"))
    outside = externals.select(F.col("isgl1_key").alias("key"), F.lit(None).cast("timestamp_ntz").alias("begins"), F.lit(None).cast("timestamp_ntz").alias("ends"), F.lit(False).alias("dated"))
    return own.filter("key is not null and begins is not null").unionByName(outside.filter("key is not null")).distinct()


def orphan_references(edges: DataFrame, entities: DataFrame, externals: DataFrame) -> DataFrame:
    """One row (edge_id, side, key, observed_at) per edge row and side whose key had no record at observed_at.

    A null key or an entity without first_seen_at is no record; with a null observed_at only placeholder records are
    known to exist. Repeated edge rows are repeated references. Empty tables give an empty result. Extra columns are
    ignored. The join is salted for hot keys, so one to_key may hold any share of the edges.
    """
    refs, records = references(edges), lifetimes(entities, externals)
    left, right = salted(refs, records, "key", "edge_id")
    r = right.select(F.col("key").alias("r_key"), F.col("_salt").alias("r_salt"), "begins", "ends", "dated")
    alive = ~F.col("dated") | ((F.col("begins") <= F.col("observed_at")) & (F.col("ends").isNull() | (F.col("ends") > F.col("observed_at"))))
    found = left.join(r, (F.col("key") == F.col("r_key")) & (F.col("_salt") == F.col("r_salt")) & alive, "left_anti")
    return found.select("edge_id", "side", "key", "observed_at")


def _counted(refs: DataFrame, kind: str) -> DataFrame:
    """(side, referred_table, week, kind, n_orphans): references counted per side, table referred to and week (its Monday)."""
    return (
        refs.select(
            "side",
            F.when(F.col("key").rlike(PLACEHOLDER), "external_entities").otherwise("entities").alias("referred_table"),
            F.date_format(F.date_trunc("week", F.col("observed_at").cast("timestamp")), "yyyy-MM-dd").alias("week"),
        )
        .groupBy("side", "referred_table", "week")
        .agg(F.count(F.lit(1)).alias("n_orphans"))
        .withColumn("kind", F.lit(kind))
    )


def orphan_report(edges: DataFrame, entities: DataFrame, externals: DataFrame) -> DataFrame:
    """(side, referred_table, week, kind, n_orphans): `direct` references have no record at the time; `inherited` ones have
    one, but of an entity that the cascade found: it holds an orphan reference, or reaches one through other entities.

    Weeks are named by their Monday; null where observed_at is. Nulls, repeats and empty tables as in orphan_references.
    """
    direct = cut(orphan_references(edges, entities, externals))
    reached = orphan_cascade(edges, entities, externals, orphans=direct).select(F.col("isgl1_key").alias("key"))
    inherited = spread_join(references(edges), cut(reached), "key", "edge_id", how="left_semi")
    inherited = inherited.join(direct.select("edge_id", "side"), ["edge_id", "side"], "left_anti")
    return _counted(direct, "direct").unionByName(_counted(inherited, "inherited"))


def orphan_cascade(edges: DataFrame, entities: DataFrame, externals: DataFrame, max_depth: int = 1000, orphans: DataFrame | None = None) -> DataFrame:
    """(isgl1_key, depth, kind): entities that hold an orphan reference (`direct`, depth 0) or that reach one through
    other entities (`inherited`, depth = number of references between).

    Fixpoint: the frontier is semi-joined with the distinct (from, to) pairs on to_key; only keys not yet seen go on.
    Cycles end since seen keys are dropped. max_depth guards against endless input only; reaching it raises. orphans: the
    orphan references, if they are known already.
    """
    edges, entities = pick(edges, "edge_id", "from_key", "to_key", "observed_at"), pick(entities, "isgl1_key", "first_seen_at", "removed_at")
    orphans = orphan_references(edges, entities, externals) if orphans is None else orphans
    bad = orphans.filter("side = 'to'").select("edge_id").distinct()
    known = cut(entities.filter("isgl1_key is not null").select(F.col("isgl1_key").alias("key")).distinct().withColumn("id", F.monotonically_increasing_id()))
    ids = lambda side, name: known.select(F.col("key").alias(side), F.col("id").alias(name))
    first = edges.join(bad, "edge_id", "left_semi").select("from_key").distinct().join(ids("from_key", "k"), "from_key").select("k")
    # only edges between records carry an orphan on: keys become integers before the fixpoint
    half = spread_join(edges.select("from_key", "to_key"), ids("to_key", "dst"), "to_key", "from_key").select("from_key", "dst")
    pairs = cut(spread_join(half, ids("from_key", "src"), "from_key", "dst", hot_buckets(edges, "from_key")).select("src", "dst").distinct())
    hot = hot_buckets(pairs, "dst")
    seen = level = cut(first.select("k", F.lit(0).alias("depth")))
    depth = 0
    while True:
        depth += 1
        if depth > max_depth:
            raise RuntimeError("the key graph is deeper than max_depth")
        step = spread_join(pairs, level.select(F.col("k").alias("dst")), "dst", "src", hot, "left_semi").select(F.col("src").alias("k")).distinct()
        level = cut(step.join(seen.select("k"), "k", "left_anti").select("k", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    reached = seen.join(known.withColumnRenamed("id", "k"), "k")
    return reached.select(F.col("key").alias("isgl1_key"), "depth", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("kind"))
