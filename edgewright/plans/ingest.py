"""Batch ingestion: a source tree into a store's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.operators import coverage, matching
from edgewright.operators.relations import upsert_edges
from edgewright.schemas import ENTITIES
from edgewright.session import cut
from edgewright.sinks.text import error_log
from edgewright.sources import extraction, files
from edgewright.sources.catalog import Store


def entity_rows(found: DataFrame) -> DataFrame:
    """Extracted entities in all columns of the relation."""
    fixed = {
        "tdd_classification": F.to_json(F.struct("entity_class", F.lit("Medium").alias("testability"), F.lit("Simple").alias("complexity"), F.lit(0).alias("dependencies"), F.lit(False).alias("critical_path"), F.lit("Low").alias("change_risk"))),
        "last_modified": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
    }
    have = found.withColumns(fixed)
    return have.select(*[F.col(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTITIES.fields]).dropDuplicates(["isgl1_key"])


def placeholder_rows(edges: DataFrame) -> DataFrame:
    """Records for the keys outside the code base that edges point to, in all columns of the relation."""
    p = matching.placeholder_entities(edges)
    path = F.when(F.col("crate_name").isNull(), "unresolved-reference").otherwise(F.concat(F.lit("external-dependency-"), "crate_name"))
    name = F.col("entity_name")
    sig = F.to_json(F.struct("entity_type", name.alias("name"), F.lit("Public").alias("visibility"), path.alias("file_path"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("line_range")))
    rows = p.withColumns({"file_path": path, "interface_signature": sig, "entity_class": F.lit("CODE"), "current_ind": F.lit(True), "future_ind": F.lit(True), "root_subfolder_l1": F.lit("."), "root_subfolder_l2": F.lit("")})
    return entity_rows(rows)


def ingest(store: Store, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_size: int = files.MAX_SIZE) -> DataFrame:
    """Read, extract and write the tree below root; returns one row of totals.

    Test entities are kept out of the entity relation and listed as excluded; their edges stay. Files too large, not
    UTF-8 or without an extractor are reported. Each relation is replaced.
    """
    spark = store.spark
    tree = files.eligible(files.walk(spark, root), include, exclude, files.nested_repositories(spark, root))
    prefix = root.rstrip("/").removeprefix("file:") + "/"
    short = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), f"^{prefix}", "")
    keep = tree.select(short(F.col("path")).alias("file_path"))
    texts, errors = files.read_texts(spark, root, max_size)
    texts = cut(texts.withColumn("file_path", short(F.col("file_path"))).join(keep, "file_path", "left_semi"))
    errors = cut(errors.withColumn("file_path", short(F.col("file_path"))).join(keep, "file_path", "left_semi"))
    rows = cut(extraction.extracted(texts))
    found = cut(extraction.as_entities(texts, rows))
    edges = cut(extraction.extracted_edges(texts, rows, found))
    code = entity_rows(found.filter("entity_class = 'CODE'"))
    store.write("entities", code.unionByName(placeholder_rows(edges)))
    store.write("edges", upsert_edges(edges.limit(0), edges))
    store.write("excluded_tests", coverage.excluded_tests(found))
    store.write("word_coverage", coverage.word_coverage(texts, found))
    store.write("ignored_files", coverage.ignored_files(keep))
    store.write("file_hash_cache", texts.select("file_path", F.sha2("current_code", 256).alias("content_hash"), F.current_timestamp().cast("timestamp_ntz").alias("last_updated")))
    error_log(errors).write.mode("overwrite").text(f"{store.path}/ingestion-errors")
    n = (keep.count(), texts.count(), found.count(), edges.count(), errors.count())
    return spark.createDataFrame([n], "files long, processed long, entities long, edges long, errors long")
