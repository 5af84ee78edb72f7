"""Coupling, cohesion, debt, entropy and degree metrics per node; each in a fixed number of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions.scalars import debt_severity, entropy_level, metric_status
from edgewright.operators.graph import _ranked, neighbours, node_join, nodes_of
from edgewright.operators.skew import spread_join
from edgewright.schemas import EDGE_TYPES
from edgewright.session import cut

#: Thresholds of the metrics, and hours of debt.
CBO_FAIL, LCOM_FAIL, RFC_WARN, WMC_WARN = 10, 0.8, 50, 50
DEBT_WMC, HOURS = 15, {"CBO": 4.0, "LCOM": 8.0, "WMC": 2.0}


def degrees(edges: DataFrame) -> DataFrame:
    """(key, n_in, n_out): over the edges as given; a missing side is 0."""
    ends = F.array(F.struct(F.col("from_key").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_key").alias("key"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return edges.select(F.explode(ends).alias("x")).groupBy("x.key").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))


def hotspots(pairs: DataFrame, top: int = 10) -> DataFrame:
    """(rank, key, n_in, n_out, total): the nodes of most coupling over distinct pairs; a top-k report."""
    return most_coupled(degrees(pairs), top)


def most_coupled(counted: DataFrame, top: int) -> DataFrame:
    """hotspots() of what degrees() gives."""
    rows = counted.withColumn("total", F.col("n_in") + F.col("n_out")).orderBy(F.desc("total"), "key").limit(top)
    return _ranked(rows, "rank", [F.desc("total"), F.asc("key")])


def coupling(edges: DataFrame) -> DataFrame:
    """(key, cbo): distinct neighbours, callers and callees together; an edge on itself counts the node."""
    return neighbours(edges).groupBy("key").agg(F.count(F.lit(1)).alias("cbo"))


def weighed(edges: DataFrame) -> DataFrame:
    """(from_key, to_key, w): distinct pairs with the number of their parallel edges."""
    return edges.groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("w"))


def response(edges: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """(key, rfc): distinct callees and callees of callees. children: weighed() of the edges, where that is written."""
    pairs = (weighed(edges) if children is None else children).select("from_key", "to_key")
    two = spread_join(pairs, pairs.select(F.col("from_key").alias("to_key"), F.col("to_key").alias("next")), "to_key", "from_key").select("from_key", F.col("next").alias("to_key"))
    return pairs.unionByName(two).distinct().groupBy(F.col("from_key").alias("key")).agg(F.count(F.lit(1)).alias("rfc"))


def cohesion(edges: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """(key, lcom): share of a node's pairs of children (parallel edges are children of their own) without a common
    target; 0 with fewer than two children.

    Children are taken together by their set of targets, known by an order-free signature and named by the least key that has it:
    pairs within such a class share by counting alone, and only classes, not children, are paired, over a target they have
    in common. children: weighed() of the edges, where that is written.
    """
    children = weighed(edges) if children is None else children
    pairs = children.select("from_key", "to_key")
    sets = pairs.groupBy("from_key").agg(F.sum(F.xxhash64("to_key", F.lit(1)).cast("decimal(20,0)")).cast("string").alias("a"), F.bit_xor(F.xxhash64("to_key", F.lit(2))).alias("b"), F.count(F.lit(1)).alias("n"))
    sets = cut(sets)
    first = sets.groupBy("a", "b", "n").agg(F.min("from_key").alias("sig"))
    signature = cut(sets.join(first, ["a", "b", "n"]).select(F.col("from_key").alias("to_key"), "sig"))
    all_pairs = children.groupBy("from_key").agg(F.sum("w").alias("c"))
    classes = node_join(children, signature, "to_key", "from_key").groupBy("from_key", "sig").agg(F.sum("w").alias("w"))
    classes = cut(classes)
    same = classes.groupBy("from_key").agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("shared"))
    of_class = pairs.join(signature.filter("to_key = sig").select(F.col("to_key").alias("from_key")), "from_key", "left_semi").select(F.col("from_key").alias("sig"), F.col("to_key").alias("target"))
    on = classes.join(of_class, "sig")
    other = on.select("from_key", "target", F.col("sig").alias("sig2"), F.col("w").alias("w2"))
    across = on.join(other, ["from_key", "target"]).filter("sig < sig2").select("from_key", "sig", "sig2", "w", "w2").distinct()
    across = across.groupBy("from_key").agg(F.sum(F.col("w") * F.col("w2")).alias("shared"))
    shared = same.unionByName(across).groupBy("from_key").agg(F.sum("shared").alias("shared"))
    n = F.col("c") * (F.col("c") - 1) / 2
    return all_pairs.join(shared, "from_key", "left").select(F.col("from_key").alias("key"), F.when(n > 0, 1 - F.coalesce("shared", F.lit(0.0)) / n).otherwise(0.0).alias("lcom"))


def weight(edges: DataFrame) -> DataFrame:
    """(key, wmc): edges out, parallel ones included."""
    return edges.groupBy(F.col("from_key").alias("key")).agg(F.count(F.lit(1)).alias("wmc"))


def ck_metrics(edges: DataFrame, contains: str | None = None) -> DataFrame:
    """(key, cbo, lcom, rfc, wmc, *_status, grade) per node, optionally of keys that contain a text."""
    edges = edges if getattr(edges, "_written", False) else cut(edges)  # read by each of the metrics
    children = cut(weighed(edges))
    rows = nodes_of(edges)
    for part, zero in ((coupling(children), {"cbo": 0}), (cohesion(edges, children), {"lcom": 0.0}), (response(edges, children), {"rfc": 0}), (weight(edges), {"wmc": 0})):
        rows = rows.join(part, "key", "left").na.fill(zero)
    if contains:
        rows = rows.filter(F.col("key").contains(contains))
    rows = rows.withColumns({"cbo_status": metric_status("cbo", CBO_FAIL, None), "lcom_status": metric_status("lcom", LCOM_FAIL, None), "rfc_status": metric_status("rfc", None, RFC_WARN), "wmc_status": metric_status("wmc", None, WMC_WARN)})
    statuses = [F.col(c) for c in ("cbo_status", "lcom_status", "rfc_status", "wmc_status")]
    fails = sum(((s == "FAIL").cast("int") for s in statuses), F.lit(0))
    warns = sum(((s == "WARNING").cast("int") for s in statuses), F.lit(0))
    grade = F.when(fails >= 2, "F").when((fails == 1) | (warns >= 3), "D").when(warns == 2, "C").when(warns == 1, "B").otherwise("A")
    return rows.withColumn("grade", grade)


def sqale_debt(edges: DataFrame, min_debt: float | None = None, contains: str | None = None) -> DataFrame:
    """(key, debt_hours, severity, violations) per node; violations in the order CBO, LCOM, WMC."""
    return debt_of(ck_metrics(edges, contains), min_debt)


def debt_of(m: DataFrame, min_debt: float | None = None) -> DataFrame:
    """sqale_debt() of what ck_metrics() gives."""
    hit = {"CBO": F.col("cbo") > CBO_FAIL, "LCOM": F.col("lcom") > LCOM_FAIL, "WMC": F.col("wmc") > DEBT_WMC}
    hours = sum((F.when(c, HOURS[k]).otherwise(0.0) for k, c in hit.items()), F.lit(0.0))
    names = F.filter(F.array(*[F.when(c, k) for k, c in hit.items()]), lambda x: x.isNotNull())
    rows = m.select("key", hours.alias("debt_hours"), names.alias("violations")).withColumn("severity", debt_severity("debt_hours"))
    return rows.filter(F.col("debt_hours") >= min_debt) if min_debt is not None else rows


def edge_entropy(edges: DataFrame, contains: str | None = None) -> DataFrame:
    """(key, entropy, level): Shannon entropy in bits of the types of a node's edges out; 0 without any.

    A pair of nodes has one type, the greatest of its parallel edges, which counts once per parallel edge.
    """
    typed = edges.groupBy("from_key", "to_key").agg(F.max("edge_type").alias("t"), F.count(F.lit(1)).alias("n"))
    counts = {f"n_{t}": F.sum(F.when(F.col("t") == t, F.col("n")).otherwise(0)) for t in EDGE_TYPES}
    sums = typed.groupBy(F.col("from_key").alias("key")).agg(F.sum("n").alias("total"), *[c.alias(k) for k, c in counts.items()])
    share = {k: F.col(k) / F.col("total") for k in counts}
    bits = sum((F.when(F.col(k) > 0, -p * F.log2(p)).otherwise(0.0) for k, p in share.items()), F.lit(0.0))
    rows = nodes_of(edges).join(sums, "key", "left").select("key", F.round(F.greatest(F.coalesce(bits, F.lit(0.0)), F.lit(0.0)), 12).alias("entropy"))
    if contains:
        rows = rows.filter(F.col("key").contains(contains))
    return rows.withColumn("level", entropy_level("entropy"))
