"""Neighbours, bounded impact and reachability from keys.

Lookups go from the key outwards: each step joins the edges with the frontier alone, so the graph as a whole is neither
deduplicated nor written. A frontier whose counted size is bounded is broadcast; a larger one is joined by shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.functions.scalars import name_of_key
from edgewright.operators.graph import in_one_task, sized
from edgewright.session import cut

#: A frontier of at most so many keys is broadcast (some tens of megabytes).
BROADCAST_KEYS = 200_000
#: What was found is written together after so many steps; until then each step's part stays as it was written.
MOST_PARTS = 8


def forward_keys(edges: DataFrame, key: str) -> DataFrame:
    return edges.filter(F.col("from_key") == key).select("to_key").distinct()


def reverse_keys(edges: DataFrame, key: str) -> DataFrame:
    return edges.filter(F.col("to_key") == key).select("from_key").distinct()


def callees(edges: DataFrame, key: str) -> DataFrame:
    """All edges from a key; a missing place is `unknown`."""
    return edges.filter(F.col("from_key") == key).withColumn("source_location", _place())


def _place():
    return F.when(F.coalesce("source_location", F.lit("")) == "", "unknown").otherwise(F.col("source_location"))


def callers_of(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges that call one of the keys (column `key`), with that key: to_key is the key itself, or names the same
    function or method as `rust:fn:<name>:...` or `rust:method:<name>:...`.

    The alternative is written as a union of two equi joins, never as a join on OR.
    """
    same = edges.join(keys.select("key", F.col("key").alias("to_key")), "to_key")
    named = keys.select("key", name_of_key("key").alias("name")).filter("name is not null")
    loose = edges.withColumn("name", F.when(F.col("to_key").rlike("^rust:(fn|method):[^:]*:"), name_of_key("to_key"))).filter("name is not null")
    loose = loose.join(named, "name").drop("name")
    return same.unionByName(loose).distinct()


def calls_key(key: str) -> Column:
    """Whether to_key is the key, or names the same function or method as `rust:fn:<name>:...` or `rust:method:<name>:...`."""
    own = F.col("to_key") == key
    parts = key.split(":")
    if len(parts) < 3 or not parts[2]:
        return own
    return own | F.col("to_key").startswith(f"rust:fn:{parts[2]}:") | F.col("to_key").startswith(f"rust:method:{parts[2]}:")


def callers(edges: DataFrame, key: str) -> DataFrame:
    """All edges to a key or to what is named like it; one filter, which reaches the scan."""
    return edges.filter(calls_key(key)).distinct().withColumn("source_location", _place())


def _sized(frontier: DataFrame) -> tuple[DataFrame, int]:
    """The frontier, for a broadcast if its counted size allows it, and its size."""
    n = frontier.count()
    return (F.broadcast(frontier) if n <= BROADCAST_KEYS else frontier), n


def impact_backward(edges: DataFrame, key: str, hops: int = 3) -> DataFrame:
    """(hop, from_key): callers found at each hop, breadth first; the start is never returned; one join per hop."""
    spark = edges.sparkSession
    pairs = edges.select("from_key", "to_key")
    seen, out = spark.createDataFrame([(key,)], "key string"), spark.createDataFrame([], "hop int, from_key string")
    frontier = None
    for hop in range(1, hops + 1):
        step = pairs.filter(calls_key(key)) if frontier is None else callers_of(pairs, frontier)
        new = cut(step.select(F.col("from_key").alias("key")).distinct().join(seen, "key", "left_anti"))
        frontier, n = _sized(new)
        if not n:
            break
        out = out.unionByName(new.select(F.lit(hop).alias("hop"), F.col("key").alias("from_key")))
        seen = seen.unionByName(new) if hop % MOST_PARTS else cut(seen.unionByName(new))
    return out


def impact_forward(edges: DataFrame, key: str, hops: int) -> DataFrame:
    """(node, distance): least number of edges from the key, up to `hops`; the key itself only if a cycle leads back."""
    spark = edges.sparkSession
    pairs = edges.select("from_key", "to_key")
    seen, frontier = spark.createDataFrame([], "node string, distance int"), None
    for hop in range(1, hops + 1):
        step = pairs.filter(F.col("from_key") == key) if frontier is None else pairs.join(frontier, "from_key", "left_semi")
        new = cut(step.select(F.col("to_key").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)))
        frontier, n = _sized(new.select(F.col("node").alias("from_key")))
        if not n:
            break
        seen = seen.unionByName(new) if hop % MOST_PARTS else cut(seen.unionByName(new))
    return seen


def _closure_kernel(key: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(rows["from_key"], rows["to_key"]):
            near.setdefault(a, []).append(b)
        seen: set[str] = set()
        work = [key]
        while work:
            new = [w for w in near.get(work.pop(), ()) if w not in seen]
            seen.update(new)
            work += new
        return pd.DataFrame({"node": sorted(seen)}, dtype=object)

    return run


def reachable(edges: DataFrame, key: str, kernel: bool | None = None) -> DataFrame:
    """(node): everything reachable from the key; cycles end; the key itself only if it lies on one.

    The closure may take as many steps as the graph is deep: pairs are deduplicated and written once; a graph of checked
    size is walked in one task, a larger one by a join per step.
    """
    pairs, kernel = sized(edges.select("from_key", "to_key").distinct(), kernel)
    return in_one_task(pairs, _closure_kernel(key), "node string") if kernel is True else impact_forward(pairs, key, 1 << 30).select("node")


def impact_summary(hops: DataFrame) -> DataFrame:
    return hops.groupBy("hop").agg(F.count(F.lit(1)).alias("n_affected"))
