"""The public queries as one function each: parameters in, a table and its cost hint out.

Each returns an Answer: the endpoint's name, its rows, written once, and the token hint that clients read; what else a body
holds is in `extra`, lists of members as tables of their own, since one component may hold a third of all nodes. An empty required parameter
raises BadRequest, a missing record NotFound; list and search queries may be empty. `scope` is "L1" or "L1||L2".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators import communities as C
from edgewright.operators import context, coverage, graph, metrics, traversal
from edgewright.operators import relations as R
from edgewright.session import cut
from edgewright.sources.catalog import NotFound


class BadRequest(ValueError):
    """A required parameter is missing or empty."""


@dataclass
class Answer:
    endpoint: str
    data: DataFrame | None
    tokens: int | None = None
    extra: dict = field(default_factory=dict)

    def envelope(self, most: int = 10_000) -> str:
        """The answer as one JSON text, for results of checked size."""
        import json

        from edgewright.sinks.text import json_array

        table = lambda df: json.loads(json_array(df, most))
        plain = lambda v: table(v) if isinstance(v, DataFrame) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
        out = {"success": True, "endpoint": self.endpoint, "data": plain(self.extra) | {"rows": table(self.data) if self.data is not None else []}}
        return json.dumps(out | ({"tokens": self.tokens} if self.tokens is not None else {}))


@dataclass
class Graph:
    """The edges of a scope with integers, in key order, for keys: what is ordered by these is ordered by keys."""

    nodes: DataFrame  # id, key, g: its group as communities move them
    typed: DataFrame  # from_key, to_key, edge_type
    pairs: DataFrame  # from_key, to_key, each once

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows with the keys that ids in the columns stand for, joined when they are read."""
        out = rows
        for c in columns:
            out = graph.with_keys(out, graph.same_rows(self.nodes.select("id", "key"), self.nodes), c, rows.columns[0])
        return out.select(rows.columns)

    def named_few(self, rows: DataFrame, column: str) -> DataFrame:
        """As named(), of a top-k report."""
        few = F.broadcast(rows.withColumnRenamed(column, "id"))
        return self.nodes.select("id", F.col("key").alias("_key")).join(few, "id").drop("id").withColumnRenamed("_key", column).select(rows.columns)


def _need(value: str, name: str) -> str:
    if not (value or "").strip():
        raise BadRequest(name)
    return value


class Service:
    """The endpoints over the relations: entities and edges as delivered, source files for the coverage reports.

    What several endpoints read (the edges, the same by ids, degrees, metrics) is derived and written when first asked for, once per
    scope, and kept as long as the service: later deliveries need a service of their own.
    """

    def __init__(self, spark: SparkSession, entities: DataFrame, edges: DataFrame, files: DataFrame | None = None):
        self.spark, self.raw_entities, self.raw_edges, self.files = spark, entities, edges, files
        self._kept: dict[tuple, object] = {}

    def _once(self, name: str, scope: str | None, make: Callable):
        if (name, scope or "") not in self._kept:
            self._kept[name, scope or ""] = make()
        return self._kept[name, scope or ""]

    def _all_edges(self, scope: str | None = None) -> DataFrame:
        """edges() with their places, where these were delivered, written."""
        return self._once("edges", scope, lambda: cut(self.edges(scope, "source_location" in self.raw_edges.columns)))

    def _graph(self, scope: str | None = None) -> Graph:
        def make() -> Graph:
            nodes, e = graph.indexed(self._all_edges(scope), "edge_type")
            typed = graph.same_rows(e.withColumnsRenamed({"src": "from_key", "dst": "to_key"}), e)
            pairs = cut(typed.select("from_key", "to_key").distinct())
            pairs._distinct = True
            return Graph(graph.same_rows(nodes.withColumn("g", C.group_of()), nodes), typed, pairs)

        return self._once("graph", scope, make)

    def _degrees(self, scope: str | None = None) -> DataFrame:
        return self._once("degrees", scope, lambda: cut(metrics.degrees(self._graph(scope).pairs)))

    def _metrics(self, scope: str | None = None, contains: str | None = None) -> DataFrame:
        """ck_metrics() by ids, of keys that contain a text."""
        rows = self._once("metrics", scope, lambda: cut(metrics.ck_metrics(self._graph(scope).typed)))
        return self._that_contain(rows, scope, contains)

    def _that_contain(self, rows: DataFrame, scope: str | None, contains: str | None) -> DataFrame:
        keys = self._graph(scope).nodes.filter(F.col("key").contains(contains or "")).select(F.col("id").alias("key"))
        return rows.join(keys, "key", "left_semi") if contains else rows

    def busiest(self, side: str) -> str:
        """The key with the most distinct neighbours on a side (`in` or `out`), the least key among equals."""
        row = self._degrees().orderBy(F.desc(f"n_{side}"), "key").first()
        return self._graph().nodes.filter(F.col("id") == row["key"]).first()["key"] if row else ""

    def entities(self, *columns: str) -> DataFrame:
        return R.entity_relation(self.raw_entities, *columns)

    def edges(self, scope: str | None = None, places: bool = False, side: str = "from_key") -> DataFrame:
        e = R.edge_relation(self.raw_edges) if places else R.edge_types(self.raw_edges)
        return R.scoped_edges(e, self.entities("isgl1_key", "root_subfolder_l1", "root_subfolder_l2"), scope, side)

    def pairs(self, scope: str | None = None) -> DataFrame:
        return self._all_edges(scope).select("from_key", "to_key").distinct()

    # core

    def health(self) -> Answer:
        return Answer("/server-health-check-status", None, None, {"status": "ok", "version": self.spark.version})

    def statistics(self) -> Answer:
        n = self.entities("isgl1_key", "entity_class", "language")
        e = graph.rows_in(self._all_edges())
        languages = F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language"))))
        rows = n.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("entity_class") == "CODE").alias("code"), F.count_if(F.col("entity_class") == "TEST").alias("test"), F.lit(e).alias("edges"), languages.alias("languages"))
        return Answer("/codebase-statistics-overview-summary", rows, 50)

    def reference(self) -> Answer:
        """All endpoints with their parameters and defaults."""
        import inspect

        rows = []
        for name in ENDPOINTS:
            f = getattr(Service, name)
            args = [p for p in inspect.signature(f).parameters.values() if p.name != "self"]
            shown = [f"{p.name}: {p.annotation}" + ("" if p.default is p.empty else f" = {p.default!r}") for p in args]
            rows.append((name, ROUTES.get(name, ""), (f.__doc__ or "").strip(), shown, [p.name for p in args if p.default is p.empty]))
        data = self.spark.createDataFrame(rows, "function string, route string, what string, parameters array<string>, required array<string>")
        return Answer("/api-reference-documentation-help", data, None, {"api_version": "1", "total_endpoints": len(rows)})

    # entities

    def list_entities(self, entity_type: str | None = None, scope: str | None = None) -> Answer:
        """All entities, of one type and scope if given."""
        rows = R.in_scope(self.entities("isgl1_key", "file_path", "entity_type", "entity_class", "language", "root_subfolder_l1", "root_subfolder_l2"), scope)
        rows = cut(rows.filter(F.col("entity_type") == entity_type) if entity_type else rows)
        return Answer("/code-entities-list-all", rows, 50 + 20 * rows.count())

    def entity_detail(self, key: str, scope: str | None = None) -> Answer:
        """One entity with its code; a null in any column means not found."""
        rows = R.in_scope(self.entities("isgl1_key", "file_path", "entity_type", "entity_class", "language", "current_code", "root_subfolder_l1", "root_subfolder_l2").filter(F.col("isgl1_key") == _need(key, "key")), scope).dropna()
        row = rows.first()
        if row is None:
            raise NotFound(key)
        return Answer("/code-entity-detail-view", rows, 100 + len(row["current_code"].encode()))

    def search(self, q: str, scope: str | None = None) -> Answer:
        """Entities whose key contains the text, case aside."""
        rows = R.in_scope(self.entities("isgl1_key", "file_path", "entity_type", "entity_class", "language", "root_subfolder_l1", "root_subfolder_l2"), scope)
        rows = cut(rows.filter(F.lower("isgl1_key").contains(_need(q, "q").lower())))
        return Answer("/code-entities-search-fuzzy", rows, 60 + 20 * rows.count() + len(q.encode()))

    # edges

    def callers(self, entity: str, scope: str | None = None) -> Answer:
        """Edges to the entity or to one named like it."""
        rows = cut(traversal.callers(self.edges(scope, True), _need(entity, "entity")))
        n = rows.count()
        if not n:
            raise NotFound(entity)
        return Answer("/reverse-callers-query-graph", rows, 80 + 50 * n + len(entity.encode()))

    def callees(self, entity: str, scope: str | None = None) -> Answer:
        """Edges from the entity; the scope is that of the callee."""
        rows = cut(traversal.callees(self.edges(scope, True, "to_key"), _need(entity, "entity")))
        n = rows.count()
        if not n:
            raise NotFound(entity)
        return Answer("/forward-callees-query-graph", rows, 80 + 50 * n + len(entity.encode()))

    def list_edges(self, limit: int = 100, offset: int = 0, scope: str | None = None) -> Answer:
        """A page of all edges in the order of their key."""
        all_edges = self._all_edges(scope)
        rows = cut(all_edges.orderBy("from_key", "to_key", "edge_type").offset(offset).limit(limit))
        return Answer("/dependency-edges-list-all", rows, 60 + 40 * rows.count(), {"total": graph.rows_in(all_edges)})

    def _rows(self, scope: str | None) -> DataFrame:
        """Pairs for lookups, repeats included where no scope asks for a join."""
        return R.edge_rows(self.raw_edges) if not scope else self.edges(scope).select("from_key", "to_key")

    def blast_radius(self, entity: str, hops: int = 3, scope: str | None = None) -> Answer:
        """Callers by hop, with the number of those at each."""
        rows = cut(traversal.impact_backward(self._rows(scope), _need(entity, "entity"), hops))
        per_hop = traversal.impact_summary(rows).orderBy("hop")
        n = rows.count()
        if not n:
            raise NotFound(entity)
        return Answer("/blast-radius-impact-analysis", rows.orderBy("hop", "from_key"), 80 + 30 * n + len(entity.encode()), {"total": n, "by_hop": per_hop})

    # graph

    def cycles(self, scope: str | None = None) -> Answer:
        """Cycles, one per back edge."""
        rows = cut(graph.cycles(self._all_edges(scope).select("from_key", "to_key")))
        got = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("path")), F.lit(0))).first()
        return Answer("/circular-dependency-detection-scan", rows, 60 + 20 * got[0] + 15 * got[1], {"total_cycles": got[0], "has_cycles": got[0] > 0})

    def hotspots(self, top: int = 10, scope: str | None = None) -> Answer:
        """The most coupled nodes."""
        rows = cut(self._graph(scope).named_few(metrics.most_coupled(self._degrees(scope), top), "key"))
        return Answer("/complexity-hotspots-ranking-view", rows, 80 + 25 * rows.count())

    def clusters(self, scope: str | None = None) -> Answer:
        """Clusters by label propagation, largest first; members in extra."""
        g = self._graph(scope)
        labels = cut(C.label_clusters(g.pairs))
        rows = cut(C.cluster_edges(g.pairs, labels))
        names = g.nodes.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]  # each node has a label
        members = g.named(labels.join(rows.select("label", "cluster_id"), "label").select("cluster_id", "key"), "key").orderBy("cluster_id", "key")
        return Answer("/semantic-cluster-grouping-list", g.named(rows, "label").orderBy("cluster_id"), 80 + 30 * rows.count() + names // 4, {"members": members})

    def smart_context(self, focus: str, tokens: int = 4000, scope: str | None = None) -> Answer:
        """What is most relevant to a focus within a token budget."""
        rows = context.smart_context(self._rows(scope), _need(focus, "focus"), tokens)
        used = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("estimated_tokens"), F.lit(0))).first()
        return Answer("/smart-context-token-budget", rows.orderBy("position"), 100 + 40 * used[0], {"focus": focus, "token_budget": tokens, "tokens_used": used[1], "entities_included": used[0]})

    def components(self, scope: str | None = None) -> Answer:
        """Strongly connected components by size; members in extra."""
        g = self._graph(scope)
        parts = cut(graph.components(g.pairs))
        rows = cut(graph.component_sizes(parts))
        members = g.named(parts.join(rows.select("component", "scc_id"), "component").select("scc_id", "key"), "key").orderBy("scc_id", "key")
        return Answer("/strongly-connected-components-analysis", g.named(rows, "component").orderBy("scc_id"), 50 + 30 * rows.count() + 15 * parts.count(), {"members": members})

    def debt(self, entity: str | None = None, min_debt: float | None = None, scope: str | None = None) -> Answer:
        """Technical debt per node in hours, most first."""
        rows = cut(metrics.debt_of(self._metrics(scope, entity), min_debt))
        got = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("violations")), F.lit(0)), F.coalesce(F.sum("debt_hours"), F.lit(0.0))).first()
        return Answer("/technical-debt-sqale-scoring", self._graph(scope).named(rows, "key").orderBy(F.desc("debt_hours"), "key"), 60 + 40 * got[0] + 25 * got[1], {"total_debt_hours": got[2]})

    def kcore(self, k: int | None = None, scope: str | None = None) -> Answer:
        """Coreness and layer, most first; the greatest coreness is that before the filter."""
        from edgewright.functions.scalars import core_layer

        g = self._graph(scope)
        rows = cut(graph.coreness(g.pairs).withColumn("layer", core_layer("coreness")))
        most = rows.agg(F.max("coreness")).first()[0] or 0
        rows = rows.filter(F.col("coreness") >= k) if k is not None else rows
        return Answer("/kcore-decomposition-layering-analysis", g.named(rows, "key").orderBy(F.desc("coreness"), "key"), 50 + 25 * rows.count(), {"max_coreness": most})

    def centrality(self, method: str = "pagerank", top: int | None = None, scope: str | None = None) -> Answer:
        """Nodes ranked by PageRank or betweenness; an unknown method ranks by PageRank and is echoed."""
        g = self._graph(scope)
        rows = cut(graph.ranked_scores(graph.betweenness(g.typed) if method == "betweenness" else graph.pagerank(g.typed), top))
        return Answer("/centrality-measures-entity-ranking", (g.named(rows, "key") if top is None else g.named_few(rows, "key")).orderBy("rank"), 50 + 30 * rows.count(), {"method": method})

    def entropy(self, entity: str | None = None, scope: str | None = None) -> Answer:
        """Entropy of the types of edges out, most first."""
        g = self._graph(scope)
        rows = cut(self._that_contain(metrics.edge_entropy(g.typed), scope, entity))
        return Answer("/entropy-complexity-measurement-scores", g.named(rows, "key").orderBy(F.desc("entropy"), "key"), 50 + 25 * rows.count())

    def coupling(self, entity: str | None = None, scope: str | None = None) -> Answer:
        """Coupling and cohesion metrics with a grade, most coupled first."""
        rows = self._metrics(scope, entity)
        rows = rows if getattr(rows, "_written", False) else cut(rows)
        return Answer("/coupling-cohesion-metrics-suite", self._graph(scope).named(rows, "key").orderBy(F.desc("cbo"), "key"), 50 + 35 * rows.count())

    def communities(self, scope: str | None = None) -> Answer:
        """Communities, largest first, and their modularity; members in extra."""
        g = self._graph(scope)
        parts = cut(C.communities(g.typed, groups=g.nodes))
        rows = cut(parts.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("first")))
        q = C.modularity(g.typed, parts).first()[0]
        return Answer("/leiden-community-detection-clusters", g.named(rows, "first").orderBy(F.desc("size"), "community"), 60 + 25 * rows.count() + 15 * parts.count(), {"modularity": q, "members": g.named(parts, "key").orderBy("community", "key")})

    # ingestion

    def folder_coverage(self, depth: int = 2) -> Answer:
        """Coverage per folder at a depth, lowest first, with totals and what is left."""
        ents = cut(self.entities("isgl1_key", "file_path"))
        rows = cut(coverage.folder_coverage(self.files, ents, depth))
        left = cut(coverage.unparsed_files(self.files, ents))
        summary = coverage.coverage_summary(self.files, ents, self._all_edges())
        return Answer("/ingestion-coverage-folder-report", rows.orderBy("coverage_pct", "folder_path"), 100 + 40 * rows.count() + 10 * left.count(), {"summary": summary, "unparsed_files": left.orderBy("file_path")})

    def diagnostics(self, section: str = "all") -> Answer:
        """Excluded tests, word coverage and ignored files, with counts and averages; `summary` has these alone; an unknown
        section selects nothing."""
        wanted = lambda name: section in ("all", name, "summary")
        n, body = {"test_entities": 0, "word_coverage": 0, "ignored_files": 0}, {}
        averages = (0, 0.0, 0.0)
        if wanted("test_entities"):
            tests = cut(coverage.excluded_tests(self.entities("isgl1_key", "file_path", "entity_class", "language", "interface_signature")))
            n["test_entities"] = tests.count()
            body["test_entities"] = {"total_count": n["test_entities"], "entities": tests}
        if wanted("word_coverage"):
            words = cut(coverage.word_coverage(self.files, self.entities("isgl1_key", "file_path", "entity_class", "current_code")))
            averages = tuple(coverage.coverage_averages(words).first())
            n["word_coverage"] = averages[0]
            body["word_coverage"] = {"total_files": averages[0], "avg_raw_coverage_pct": averages[1], "avg_effective_coverage_pct": averages[2], "files": words}
        if wanted("ignored_files"):
            ignored = cut(coverage.ignored_files(self.files))
            n["ignored_files"] = ignored.count()
            body["ignored_files"] = {"total_count": n["ignored_files"], "by_extension": ignored.groupBy("extension").agg(F.count(F.lit(1)).alias("n")).orderBy("extension"), "files": ignored}
        summary = self.spark.createDataFrame([(n["test_entities"], n["word_coverage"], averages[1], averages[2], n["ignored_files"])], "test_entities_count long, total_files_with_coverage long, avg_raw_coverage_pct double, avg_effective_coverage_pct double, ignored_files_count long")
        tokens = 100 if section == "summary" else 100 + 30 * n["test_entities"] + 50 * n["word_coverage"] + 20 * n["ignored_files"]
        return Answer("/ingestion-diagnostics-coverage-report", summary, tokens, {} if section == "summary" else {"sections": body})

    def folder_tree(self) -> Answer:
        """Folders of the code base with their entities."""
        rows = cut(coverage.folder_tree(self.entities("isgl1_key", "root_subfolder_l1", "root_subfolder_l2")))
        return Answer("/folder-structure-discovery-tree", rows, 100 + 30 * rows.count())

    # incremental

    def reindex(self, changes: DataFrame, cache: DataFrame) -> Answer:
        """Apply changed files; the new state is in extra."""
        from edgewright.streaming.reindex import reindex

        rng = F.from_json("interface_signature", "struct<name:string,line_range:struct<start:int,end:int>>")
        known = self.entities("isgl1_key", "file_path", "interface_signature", "content_hash", "entity_type", "language").withColumn("s", rng)
        known = known.select("isgl1_key", "s.name", "file_path", F.col("s.line_range.start").alias("line_start"), F.col("s.line_range.end").alias("line_end"), "content_hash", "entity_type", "language")
        out = reindex(known, self.edges(places=True), cache, changes)
        return Answer("/incremental-reindex-file-update", out.metrics, None, {"state": out})

    def watcher(self, query) -> Answer:
        """State of a running change stream."""
        from edgewright.streaming.reindex import status

        return Answer("/file-watcher-status-check", None, None, status(query))


#: The endpoints' public names.
ROUTES = {
    "health": "/server-health-check-status", "statistics": "/codebase-statistics-overview-summary", "reference": "/api-reference-documentation-help", "list_entities": "/code-entities-list-all", "entity_detail": "/code-entity-detail-view", "search": "/code-entities-search-fuzzy",
    "callers": "/reverse-callers-query-graph", "callees": "/forward-callees-query-graph", "list_edges": "/dependency-edges-list-all", "blast_radius": "/blast-radius-impact-analysis", "cycles": "/circular-dependency-detection-scan", "hotspots": "/complexity-hotspots-ranking-view",
    "clusters": "/semantic-cluster-grouping-list", "smart_context": "/smart-context-token-budget", "components": "/strongly-connected-components-analysis", "debt": "/technical-debt-sqale-scoring", "kcore": "/kcore-decomposition-layering-analysis", "centrality": "/centrality-measures-entity-ranking",
    "entropy": "/entropy-complexity-measurement-scores", "coupling": "/coupling-cohesion-metrics-suite", "communities": "/leiden-community-detection-clusters", "folder_coverage": "/ingestion-coverage-folder-report", "diagnostics": "/ingestion-diagnostics-coverage-report",
    "folder_tree": "/folder-structure-discovery-tree", "reindex": "/incremental-reindex-file-update", "watcher": "/file-watcher-status-check",
}
#: Functions of the service that are endpoints.
ENDPOINTS = [n for n in vars(Service) if not n.startswith("_") and n not in ("entities", "edges", "pairs", "busiest")]
