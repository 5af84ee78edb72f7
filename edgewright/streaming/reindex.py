"""Incremental re-indexing of changed files, as batches of a file stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.functions.scalars import extension_of
from edgewright.operators.matching import match_entities, removed_entities
from edgewright.operators.relations import delete_by_keys, delete_edges_from, latest, upsert
from edgewright.schemas import FILE_CHANGES
from edgewright.session import cut
from edgewright.sources.catalog import Store
from edgewright.sources.extraction import as_entities, extracted, extracted_edges


def file_changes(spark: SparkSession, folder: str, files_per_batch: int = 100, watched: tuple[str, ...] = ()) -> DataFrame:
    """The stream of change events dropped into a folder as JSON, of files with a watched extension if any are named;
    the trigger takes a bounded number of files."""
    rows = spark.readStream.schema(FILE_CHANGES).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.filter(extension_of("file_path").isin(*watched)) if watched else rows


def debounced(changes: DataFrame) -> DataFrame:
    """The last event per file of a batch, with the number of events it stands for."""
    n = F.count(F.lit(1)).over(Window.partitionBy("file_path"))
    return latest(changes.filter("file_path is not null").withColumn("n_events", n), ["file_path"], F.desc("changed_at"), F.desc("change_type"))


def unchanged(changes: DataFrame, cache: DataFrame) -> DataFrame:
    """Events whose content has the cached hash: nothing is to be done for them."""
    h = changes.withColumn("content_hash", F.sha2("content", 256))
    return h.join(cache.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi")


@dataclass
class Indexed:
    """State after a batch: the relations and per file what happened to it."""

    entities: DataFrame
    edges: DataFrame
    cache: DataFrame
    metrics: DataFrame


def reindex(entities: DataFrame, edges: DataFrame, cache: DataFrame, changes: DataFrame) -> Indexed:
    """Apply the last event of each file to the relations.

    entities: isgl1_key, name, file_path, line_start, line_end, content_hash, entity_type, language; edges as the
    relation; cache: file_path, content_hash. Entities keep their key if content or position match, others of the file
    are removed with their edges out, new ones are put in; the hash is cached. An event without content (a parse or read
    failure) purges the file and is not cached; `Deleted` purges it and its cached hash. An unchanged hash is a no-op.
    metrics: (file_path, n_events (those before the last were coalesced), entities_before, entities_after, entities_added, entities_removed, edges_added, edges_removed,
    hash_changed), with after = before - removed + added.
    """
    last = cut(debounced(changes))
    same = unchanged(last.filter("change_type <> 'Deleted'"), cache).select("file_path")
    todo = cut(last.join(same, "file_path", "left_anti"))
    texts = todo.filter("change_type <> 'Deleted' and content is not null").select("file_path", F.col("content").alias("current_code"))
    old = cut(entities.join(todo.select("file_path"), "file_path", "left_semi").withColumnRenamed("isgl1_key", "key"))
    rows = cut(extracted(texts))
    new = cut(as_entities(texts, rows).select("isgl1_key", "name", "file_path", "line_start", "line_end", "content_hash", "entity_type", "language"))
    matched = cut(match_entities(new, old))
    kept = matched.withColumn("isgl1_key", F.coalesce("old_key", "isgl1_key")).drop("old_key", "match")
    gone = cut(removed_entities(old, matched).select("key", "file_path"))
    left = delete_by_keys(entities, gone.select("key"), "isgl1_key")
    entities_out = upsert(left, kept.dropDuplicates(["isgl1_key"]), ["isgl1_key"])
    edges_left, edges_gone = delete_edges_from(edges, gone.select("key"))
    found = cut(extracted_edges(texts, rows, kept))
    edges_out = upsert(edges_left, found, ["from_key", "to_key", "edge_type"])
    hashes = texts.select("file_path", F.sha2("current_code", 256).alias("content_hash"))
    cache_out = cache.select("file_path", "content_hash").join(todo.select("file_path"), "file_path", "left_anti").unionByName(hashes)
    per = lambda df, path, name: df.groupBy(F.col(path).alias("file_path")).agg(F.count(F.lit(1)).alias(name))
    owner = gone.select(F.col("key").alias("from_key"), "file_path")
    m = last.select("file_path", "n_events")
    for part in (
        per(old, "file_path", "entities_before"), per(matched.filter("match = 'new'"), "file_path", "entities_added"), per(gone, "file_path", "entities_removed"),
        per(found.withColumn("file_path", F.regexp_replace("source_location", r":\d+$", "")), "file_path", "edges_added"), per(edges_gone.join(owner, "from_key"), "file_path", "edges_removed"),
    ):
        m = m.join(part, "file_path", "left")
    counts = ["entities_before", "entities_added", "entities_removed", "edges_added", "edges_removed"]
    m = m.na.fill(0, counts).join(same.withColumn("_same", F.lit(True)), "file_path", "left")
    metrics = m.select("file_path", "n_events", "entities_before", (F.col("entities_before") - F.col("entities_removed") + F.col("entities_added")).alias("entities_after"), *counts[1:], F.col("_same").isNull().alias("hash_changed"))
    return Indexed(entities_out, edges_out, cache_out, metrics)


def start(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = False, watched: tuple[str, ...] = (), source: Callable[..., DataFrame] = file_changes):
    """Run the stream against a store; returns the query, whose status, lastProgress and stop() serve the status report.

    watched: extensions of the files to take, all if none are named; source: another provider of the change stream, a
    function of session, folder and watched.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        out = reindex(store.read("indexed_entities"), store.read("indexed_edges"), store.read("file_hash_cache").select("file_path", "content_hash"), batch)
        done = {n: cut(d) for n, d in (("indexed_entities", out.entities), ("indexed_edges", out.edges), ("file_hash_cache", out.cache))}
        cut(out.metrics).write.mode("append").parquet(f"{store.path}/reindex_metrics.parquet")
        for name, rows in done.items():
            store.write(name, rows)

    writer = source(spark, folder, watched=watched).writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="100 milliseconds").start()


class Watcher:
    """One running change stream: starting it twice is an error, stopping it is not."""

    def __init__(self, spark: SparkSession, folder: str, store: Store, checkpoint: str, watched: tuple[str, ...] = ()):
        self._args, self.query, self.watched = (spark, folder, store, checkpoint), None, watched

    def start(self, once: bool = False) -> None:
        if self.query is not None and self.query.isActive:
            raise RuntimeError("the watcher runs already")
        self.query = start(*self._args, once=once, watched=self.watched)

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def status(self) -> dict:
        return status(self.query) if self.query is not None else {"running": False, "message": "not started", "batches": 0, "last_rows": 0}


def status(query) -> dict:
    """Whether a stream runs, its message, batches so far, events of the batches that the stream still remembers and the last batch's size."""
    last = query.lastProgress
    return {
        "running": query.isActive, "message": query.status["message"], "batches": last["batchId"] + 1 if last else 0, "last_rows": last["numInputRows"] if last else 0,
        "recent_events": sum(p["numInputRows"] for p in query.recentProgress),
    }
