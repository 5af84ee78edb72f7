"""A graph exported as one JSON document per row, {"entities": [...], "edges": [...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.schemas import EDGE_TYPES, JSON_GRAPH


def parsed(docs: DataFrame, text: str = "json") -> DataFrame:
    return docs.select(F.from_json(text, JSON_GRAPH).alias("g"))


def doc_entities(docs: DataFrame, text: str = "json") -> DataFrame:
    return parsed(docs, text).select(F.explode("g.entities").alias("e")).select("e.*")


def doc_edges(docs: DataFrame, edge_type: str | None = None, text: str = "json") -> DataFrame:
    """Edges of the documents, of one type if given; an unknown type is an error."""
    if edge_type is not None and edge_type not in EDGE_TYPES:
        raise ValueError(f"unknown edge type {edge_type}")
    rows = parsed(docs, text).select(F.explode("g.edges").alias("e")).select("e.*")
    return rows.filter(F.col("edge_type") == edge_type) if edge_type else rows


def reverse_dependencies(docs: DataFrame, key: str, text: str = "json") -> DataFrame:
    """(from_key): the reverse_deps that the document lists for an entity."""
    return doc_entities(docs, text).filter(F.col("isgl1_key") == key).select(F.explode("reverse_deps").alias("from_key"))


def entities_in_path(docs: DataFrame, pattern: str, text: str = "json") -> DataFrame:
    return doc_entities(docs, text).filter(F.col("file_path").contains(pattern))


def call_chain(edges: DataFrame, start: str, most: int | None = None) -> list[str]:
    """From a key along the first Calls edge (least target) of each; ends where a key repeats, so cycles end too.

    A chain of more than `most` steps, if given, is an error.
    """
    firsts = edges.filter("edge_type = 'Calls'").groupBy("from_key").agg(F.min("to_key").alias("to_key"))
    chain, seen = [start], {start}
    while True:
        row = firsts.filter(F.col("from_key") == chain[-1]).first()
        if row is None or row[1] in seen:
            return chain
        if most is not None and len(chain) > most:
            raise RuntimeError(f"the chain from {start} has more than {most} steps")
        chain.append(row[1])
        seen.add(row[1])


def graph_document(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, json): one document per source file, its entities and their edges out, so that none holds the whole graph."""
    e = entities.select("file_path", F.struct("isgl1_key", F.get(F.split("isgl1_key", ":"), F.lit(2)).alias("name"), "file_path").alias("e"))
    e = e.groupBy("file_path").agg(F.sort_array(F.collect_list("e")).alias("entities"))
    owner = entities.select(F.col("isgl1_key").alias("from_key"), "file_path")
    d = edges.join(owner, "from_key").select("file_path", F.struct("from_key", "to_key", "edge_type").alias("d"))
    d = d.groupBy("file_path").agg(F.sort_array(F.collect_list("d")).alias("edges"))
    return e.join(d, "file_path", "left").select("file_path", F.to_json(F.struct("entities", "edges")).alias("json"))
