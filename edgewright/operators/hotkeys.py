"""Problem 6: results per key though a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.columns import pick


def key_statistics(edges: DataFrame) -> DataFrame:
    """(to_key, edge_type, n_rows, n_from_keys, first_observed_at, last_observed_at), keys compared exactly.

    Rows are combined on the map side to one state per (to_key, edge_type, from_key) and shuffled by all three, so a
    hot key is spread over all tasks; only these compact states are combined again, per pair, on both sides of the
    second shuffle. Null keys and types are groups of their own; a null from_key counts as a row but as no key.
    An empty table gives an empty result; extra columns are ignored.
    """
    edges = pick(edges, "from_key", "to_key", "edge_type", "observed_at")
    fine = edges.groupBy("to_key", "edge_type", "from_key").agg(F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi"))
    return fine.groupBy("to_key", "edge_type").agg(
        F.sum("n").alias("n_rows"), F.count("from_key").alias("n_from_keys"), F.min("lo").alias("first_observed_at"), F.max("hi").alias("last_observed_at")
    )


def heavy_pairs(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(to_key, edge_type) of the pairs that hold at least `share` of all rows, from key_statistics."""
    total = edges.count()
    return key_statistics(edges).filter(F.col("n_rows") >= F.lit(total) * F.lit(share)).select("to_key", "edge_type")
