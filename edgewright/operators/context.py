"""Context around a focus entity within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions.scalars import estimated_tokens
from edgewright.operators.traversal import impact_forward
from edgewright.session import cut

DEPTHS = 3


def smart_context(edges: DataFrame, focus: str, budget: int = 4000) -> DataFrame:
    """(position, key, relevance, relevance_type, estimated_tokens): callers, callees and what they lead to, by relevance,
    as many as the budget holds.

    Callers come first, then callees, then what lies up to DEPTHS + 1 steps ahead by least distance, each in key order.
    The neighbourhood is found by joins from the focus outwards, so the result does not depend on the graph's size.
    """
    pairs = edges.select("from_key", "to_key")
    return _in_order(pairs, focus, budget, cut(impact_forward(pairs, focus, DEPTHS + 1)))


def _in_order(pairs: DataFrame, focus: str, budget: int, ahead: DataFrame) -> DataFrame:
    """Callers and callees by key, then the rest by least distance and key, a page at a time.

    An item costs at least 100 tokens, so the budget bounds the items; what no longer fits is not fetched.
    """
    callers = pairs.filter(F.col("to_key") == focus).select(F.col("from_key").alias("key"), F.lit(0).alias("rank"))
    items = callers.unionByName(ahead.select(F.col("node").alias("key"), F.col("distance").cast("int").alias("rank"))).filter(F.col("key") != focus)
    items = cut(items.groupBy("key").agg(F.min("rank").alias("rank")).withColumn("tokens", estimated_tokens("key")))
    kinds = [("direct_caller", 1.0), ("direct_callee", 0.95)] + [(f"transitive_depth_{d + 1}", max(0.1, 0.7 - 0.1 * d)) for d in range(1, DEPTHS + 1)]
    out, used, last = [], 0, (-1, "")
    while budget - used >= 100:
        left = budget - used
        rest = items.filter((F.col("rank") > last[0]) | ((F.col("rank") == last[0]) & (F.col("key") > last[1]))).filter(F.col("tokens") <= left)
        page = rest.orderBy("rank", "key").limit(left // 100).collect()
        if not page:
            break
        for key, rank, tokens in page:
            if used + tokens <= budget:
                used += tokens
                out.append((len(out) + 1, key, kinds[rank][1], kinds[rank][0], tokens))
        last = (page[-1].rank, page[-1].key)
    return pairs.sparkSession.createDataFrame(out, "position int, key string, relevance double, relevance_type string, estimated_tokens int")
