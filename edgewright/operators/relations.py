"""Relations as sets of keyed rows: reading deliveries, writing and deleting by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.schemas import EDGE_TYPES


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row per key by the given descending order; a top-1 limit is applied before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def edge_relation(edges: DataFrame) -> DataFrame:
    """(from_key, to_key, edge_type, source_location): one row per edge; unknown types are skipped, a missing place is "".

    Of repeated deliveries the place of the last received counts. Empty or null keys are no edge.
    """
    known = edges.filter(F.col("edge_type").isin(*EDGE_TYPES) & (F.length("from_key") > 0) & (F.length("to_key") > 0))
    order = [c for c in ("received_at", "edge_id") if c in edges.columns]
    place = F.coalesce("source_location", F.lit(""))
    pick = F.max_by(place, F.struct(*order)) if order else F.max(place)
    return known.groupBy("from_key", "to_key", "edge_type").agg(pick.alias("source_location"))


def edge_types(edges: DataFrame) -> DataFrame:
    """(from_key, to_key, edge_type): the multigraph without places; combined on the map side."""
    known = edges.filter(F.col("edge_type").isin(*EDGE_TYPES) & (F.length("from_key") > 0) & (F.length("to_key") > 0))
    return known.select("from_key", "to_key", "edge_type").distinct()


def edge_rows(edges: DataFrame) -> DataFrame:
    """(from_key, to_key) of every delivery that is an edge, repeated ones included: for lookups that deduplicate what they find."""
    return edges.filter(F.col("edge_type").isin(*EDGE_TYPES) & (F.length("from_key") > 0) & (F.length("to_key") > 0)).select("from_key", "to_key")


def edge_pairs(edges: DataFrame) -> DataFrame:
    """(from_key, to_key): the simple graph, parallel edges of different types collapsed."""
    return edge_rows(edges).distinct()


def entity_relation(entities: DataFrame, *columns: str) -> DataFrame:
    """One row per isgl1_key, the last ingested, with the columns asked for (all by default)."""
    cols = list(columns) or [c for c in entities.columns if c != "ingested_at"]
    if "ingested_at" not in entities.columns:
        return entities.select(*cols).dropDuplicates(["isgl1_key"])
    return latest(entities.select(*dict.fromkeys([*cols, "isgl1_key", "ingested_at"])), ["isgl1_key"], F.desc("ingested_at")).select(*cols)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """target with the rows of changes put in by key, the last by `seq` winning; repeated puts are idempotent."""
    new = latest(changes, keys, F.desc(seq)) if seq else changes.dropDuplicates(keys)
    new = new.select(*target.columns)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_edges(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges put in by their three-part key; edges with an empty key are rejected."""
    ok = changes.filter((F.length("from_key") > 0) & (F.length("to_key") > 0) & F.col("edge_type").isin(*EDGE_TYPES))
    return upsert(target, ok, ["from_key", "to_key", "edge_type"])


def delete_by_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti")


def delete_edges_from(edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, edges removed) when all edges from the given keys go."""
    gone = keys.select(F.col(keys.columns[0]).alias("from_key")).distinct()
    return edges.join(gone, "from_key", "left_anti"), edges.join(gone, "from_key", "left_semi")


def in_scope(rows: DataFrame, scope: str | None) -> DataFrame:
    """Rows of a scope "L1" or "L1||L2" (parts trimmed, an empty part is no filter)."""
    parts = [p.strip() for p in (scope or "").split("||")]
    for col, want in zip(("root_subfolder_l1", "root_subfolder_l2"), parts):
        if want:
            rows = rows.filter(F.col(col) == want)
    return rows


def scoped_edges(edges: DataFrame, entities: DataFrame, scope: str | None, side: str = "from_key") -> DataFrame:
    """Edges whose from_key (or to_key) is an entity of the scope; no scope keeps all edges."""
    if not (scope or "").replace("||", "").strip():
        return edges
    keys = in_scope(entities, scope).select(F.col("isgl1_key").alias(side)).distinct()
    return edges.join(keys, side, "left_semi")


def scope_suggestions(entities: DataFrame, scope: str) -> DataFrame:
    """(suggestion): up to ten scopes "L1" and "L1||L2" that begin with the same letter, in order; a top-k report."""
    names = entities.select("root_subfolder_l1", "root_subfolder_l2").distinct()
    both = names.select(F.col("root_subfolder_l1").alias("suggestion")).unionByName(
        names.filter("root_subfolder_l2 <> ''").select(F.concat_ws("||", "root_subfolder_l1", "root_subfolder_l2").alias("suggestion"))
    )
    same = F.lower(F.substring("suggestion", 1, 1)) == scope.strip()[:1].lower()
    return both.distinct().filter(same).orderBy("suggestion").limit(10)


def scope_exists(entities: DataFrame, scope: str) -> bool:
    return not in_scope(entities, scope).limit(1).isEmpty()
