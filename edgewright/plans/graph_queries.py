"""Registered queries of the dependency graph's own operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.functions import scalars as S
from edgewright.operators import communities as C
from edgewright.operators import context, coverage, graph, matching, metrics, temporal, traversal
from edgewright.operators import relations as R
from edgewright.sinks import text as sink
from edgewright.sources import catalog, extraction, json_graph
from edgewright.session import cut
from edgewright.sources.tables import table

TABLES = ["coverage_reports", "documents", "edges", "entities", "entity_snapshots", "entity_states", "external_entities", "mix_targets", "source_files"]


def edges(spark, d):
    return R.edge_relation(table(spark, d, "edges"))


def typed(spark, d):
    return R.edge_types(table(spark, d, "edges"))


def pairs(spark, d):
    return R.edge_pairs(table(spark, d, "edges"))


def entities(spark, d, *columns):
    return R.entity_relation(table(spark, d, "entities"), *columns)


def busiest(spark, d, side: str) -> str:
    """The key with the most distinct neighbours on a side (`in`, `out`, or `both`: the greatest product), the least key among equals."""
    if side == "both":
        row = metrics.degrees(pairs(spark, d)).orderBy(F.desc(F.col("n_in") * F.col("n_out")), "key").first()
    else:
        row = pairs(spark, d).groupBy(F.col("to_key" if side == "in" else "from_key").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").first()
    return row[0] if row else ""


def main_scope(spark, d) -> str:
    row = entities(spark, d, "isgl1_key", "root_subfolder_l1").groupBy("root_subfolder_l1").count().orderBy(F.desc("count"), "root_subfolder_l1").first()
    return row[0] if row else ""


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "with recursive " + _PRELUDE + sql
        return f

    return add


_PRELUDE = """e as (select from_key, to_key, edge_type, arg_max(coalesce(source_location, ''), (received_at, edge_id)) as source_location
        from edges where edge_type in ('Calls', 'Uses', 'Implements') group by all),
  p as (select distinct from_key, to_key from e),
  n as (select * from entities qualify row_number() over (partition by isgl1_key order by ingested_at desc) = 1),
  v as (select from_key as key from e union select to_key from e),
  deg as (select key, coalesce(i, 0) as n_in, coalesce(o, 0) as n_out from v
        left join (select to_key as key, count(*) as i from p group by all) using (key) left join (select from_key as key, count(*) as o from p group by all) using (key)),
  hot_in as (select key from deg order by n_in desc, key limit 1), hot_out as (select key from deg order by n_out desc, key limit 1),
  scope as (select root_subfolder_l1 as l1 from n group by 1 order by count(*) desc, 1 limit 1)
"""


# ---- relations, listing and search -------------------------------------------------------------------------------


@query(" ".join(f"{'union all' if i else ''} select '{t}' as relation, count(*) as n_rows from {t}" for i, t in enumerate(TABLES)))
def relation_counts(spark, d):
    return catalog.relation_counts(spark, d, TABLES)


@query("select from_key, to_key, edge_type, source_location from e")
def edge_relation(spark, d):
    return edges(spark, d)


_LISTED = ("isgl1_key", "file_path", "language", "entity_type", "entity_class", "root_subfolder_l1", "root_subfolder_l2")


@query(f"select {', '.join(_LISTED)} from n")
def entity_relation(spark, d):
    return entities(spark, d, *_LISTED)


@query("select count(*) filter (entity_class = 'CODE') as n_code, count(*) filter (entity_class = 'TEST') as n_test, (select count(*) from e) as n_edges, array_to_string(list_sort(list(distinct language) filter (language <> '')), ',') as languages from n")
def statistics_overview(spark, d):
    one = entities(spark, d, "isgl1_key", "entity_class", "language")
    lang = F.array_join(F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))), ",")
    n = edges(spark, d).count()
    return one.agg(F.count_if(F.col("entity_class") == "CODE").alias("n_code"), F.count_if(F.col("entity_class") == "TEST").alias("n_test"), F.lit(n).cast("long").alias("n_edges"), lang.alias("languages"))


@query("select isgl1_key, file_path, entity_class, language from n where entity_type = 'function'")
def entities_of_type(spark, d):
    return entities(spark, d, "isgl1_key", "file_path", "entity_class", "language", "entity_type").filter("entity_type = 'function'").drop("entity_type")


@query("select isgl1_key, file_path, entity_type, language from n where contains(lower(isgl1_key), 'walker')")
def entity_search(spark, d):
    rows = entities(spark, d, "isgl1_key", "file_path", "entity_type", "language")
    return rows.filter(F.lower("isgl1_key").contains("WALKER".lower()))


@query("select isgl1_key, file_path, entity_type, entity_class, language, current_code from n where isgl1_key is not null and current_code is not null and root_subfolder_l1 = (select l1 from scope)")
def entity_details(spark, d):
    scope = main_scope(spark, d)
    rows = entities(spark, d, "isgl1_key", "file_path", "entity_type", "entity_class", "language", "current_code", "root_subfolder_l1", "root_subfolder_l2")
    return R.in_scope(rows, scope).drop("root_subfolder_l1", "root_subfolder_l2").dropna()


@query("select from_key, to_key, edge_type from e where from_key in (select isgl1_key from n where root_subfolder_l1 = (select l1 from scope))")
def scoped_edges_from(spark, d):
    return R.scoped_edges(typed(spark, d), entities(spark, d, "isgl1_key", "root_subfolder_l1", "root_subfolder_l2"), main_scope(spark, d))


@query("select from_key, to_key, edge_type from e where to_key in (select isgl1_key from n where root_subfolder_l1 = (select l1 from scope))")
def scoped_edges_to(spark, d):
    return R.scoped_edges(typed(spark, d), entities(spark, d, "isgl1_key", "root_subfolder_l1", "root_subfolder_l2"), main_scope(spark, d), "to_key")


@query("""select suggestion from (select distinct root_subfolder_l1 as suggestion from n union select distinct root_subfolder_l1 || '||' || root_subfolder_l2 from n where root_subfolder_l2 <> '')
       where lower(suggestion[1]) = lower((select l1[1] from scope)) order by 1 limit 10""")
def scope_suggestions(spark, d):
    return R.scope_suggestions(entities(spark, d, "isgl1_key", "root_subfolder_l1", "root_subfolder_l2"), main_scope(spark, d))


@query("select from_key, to_key, edge_type, source_location from e order by from_key, to_key, edge_type limit 100 offset 100")
def edges_page(spark, d):
    return edges(spark, d).orderBy("from_key", "to_key", "edge_type").offset(100).limit(100)


# ---- neighbours and reach ----------------------------------------------------------------------------------------


@query("""select distinct from_key, to_key, edge_type, case when source_location = '' then 'unknown' else source_location end as source_location from e, hot_in h
       where to_key = h.key or starts_with(to_key, 'rust:fn:' || split_part(h.key, ':', 3) || ':') or starts_with(to_key, 'rust:method:' || split_part(h.key, ':', 3) || ':')""")
def callers(spark, d):
    return traversal.callers(edges(spark, d), busiest(spark, d, "in"))


@query("select from_key, to_key, edge_type, case when source_location = '' then 'unknown' else source_location end as source_location from e where from_key = (select key from hot_out)")
def callees(spark, d):
    return traversal.callees(edges(spark, d), busiest(spark, d, "out"))


@query("""select * from (with recursive b(k, hop) as (
         select key, 0 from hot_in
         union select p.from_key, hop + 1 from b join p on p.to_key = b.k
           or (regexp_matches(p.to_key, '^rust:(fn|method):') and split_part(p.to_key, ':', 3) = split_part(b.k, ':', 3) and split_part(b.k, ':', 3) <> '') where hop < 3)
       select min(hop)::int as hop, k as from_key from b group by k having min(hop) > 0)""")
def impact_backward(spark, d):
    return traversal.impact_backward(R.edge_rows(table(spark, d, "edges")), busiest(spark, d, "in"), 3)


@query("""select * from (with recursive f(k, dist) as (select key, 0 from hot_out union select p.to_key, dist + 1 from f join p on p.from_key = f.k where dist < 5)
       select k as node, min(dist)::int as distance from f where dist > 0 group by k)""")
def impact_forward(spark, d):
    return traversal.impact_forward(R.edge_rows(table(spark, d, "edges")), busiest(spark, d, "out"), 5)


@query("""select * from (with recursive r(k) as (select p.to_key from p join hot_out h on p.from_key = h.key union select p.to_key from r join p on p.from_key = r.k) select k as node from r)""")
def reachable(spark, d):
    return traversal.reachable(typed(spark, d), busiest(spark, d, "out"))


@query("select key, n_in, n_out from deg")
def degrees(spark, d):
    return metrics.degrees(pairs(spark, d))


@query("select row_number() over (order by n_in + n_out desc, key)::int as rank, key, n_in, n_out, n_in + n_out as total from deg order by total desc, key limit 10")
def hotspots(spark, d):
    return metrics.hotspots(pairs(spark, d))


# ---- whole-graph algorithms --------------------------------------------------------------------------------------

_SCC = """, inner_e as (select from_key, to_key from p where from_key in (select to_key from p) and to_key in (select from_key from p)),
  reach(a, b) as (select from_key, to_key from inner_e union select r.a, i.to_key from reach r join inner_e i on i.from_key = r.b),
  scc as (select v.key, least(v.key, coalesce(min(x.b), v.key)) as component from v left join reach x on x.a = v.key and exists (select 1 from reach y where y.a = x.b and y.b = x.a) group by v.key)"""


@query("select key, component from scc")
def components(spark, d):
    return graph.components(typed(spark, d))


@query("""select (row_number() over (order by size desc, component) - 1)::int as scc_id, component, size, case when size <= 1 then 'NONE' when size = 2 then 'MEDIUM' else 'HIGH' end as risk
       from (select component, count(*) as size from scc group by 1)""")
def component_sizes(spark, d):
    return graph.component_sizes(graph.components(typed(spark, d)))




@query()
def cycles(spark, d):
    return graph.cycles(R.edge_rows(table(spark, d, "edges")))


@query("""select (select count(distinct component) from scc where key in (select key from scc group by key) and component in (select component from scc group by 1 having count(*) > 1)
         or key in (select from_key from p where from_key = to_key)) as n_cyclic_components, 0::bigint as n_broken_steps, 0::bigint as n_not_simple, 0::bigint as n_acyclic""")
def cycle_check(spark, d):
    """Every step of every cycle is an edge, no key is passed twice, and each component with a cycle has one among them."""
    edges_ = cut(pairs(spark, d))
    inside = graph.inner_edges(edges_)
    seen = graph.inspected(inside)
    steps, first = seen.filter("to_key is not null").drop("n"), seen.filter("from_key is not null and to_key is null").select("from_key")
    odd = seen.filter("from_key is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cyclic = inside.select("component").distinct()
    had = inside.join(first, "from_key", "left_semi").select("component").distinct()
    row = (cyclic.count(), steps.join(edges_, ["from_key", "to_key"], "left_anti").count(), odd, cyclic.join(had, "component", "left_anti").count())
    return spark.createDataFrame([row], "n_cyclic_components long, n_broken_steps long, n_not_simple long, n_acyclic long")


for _q in ("components", "component_sizes", "cycle_check"):
    SQL[_q] = SQL[_q].replace(_PRELUDE, _PRELUDE.rstrip() + _SCC)


_PAGERANK = """, cnt as (select count(*)::double as n from v), od as (select from_key as key, count(*)::double as o from e group by 1),
  nodes as (select v.key, od.o from v left join od using (key)),
  pr(it, key, o, rank, prev) as (
    select 0, key, o, 1.0 / (select n from cnt), null::double from nodes
    union all
    select it + 1, t.key, t.o, 0.15 / (select n from cnt) + 0.85 * (sum(t.inc) + max(t.dang) / (select n from cnt)), max(t.rank) from (
      select it, pr.key, pr.o, pr.rank, 0.0 as inc, (sum(case when pr.o is null then pr.rank else 0 end) over ()) as dang from pr where it < 100
      union all
      select pr.it, e.to_key, nodes.o, null, pr.rank / pr.o, 0.0 from pr join e on e.from_key = pr.key join nodes on nodes.key = e.to_key where it < 100) t
    group by it, t.key, t.o),
  diffs as (select it, sum(abs(rank - prev)) as d from pr where it > 0 group by it),
  stop as (select coalesce(min(it) filter (d < 1e-6), 100) as it from diffs)"""


@query("select key, round(rank, 8) as score from pr where it = (select it from stop)")
def pagerank(spark, d):
    return rounded(graph.pagerank(typed(spark, d)), "score", digits=8)


@query("select row_number() over (order by score desc, key)::int as rank, key, score from (select key, round(rank, 8) as score from pr where it = (select it from stop))")
def pagerank_ranking(spark, d):
    return graph.ranked_scores(rounded(graph.pagerank(typed(spark, d)), "score", digits=8))


for _q in ("pagerank", "pagerank_ranking"):
    SQL[_q] = SQL[_q].replace(_PRELUDE, _PRELUDE.rstrip() + _PAGERANK)

#: Shortest paths from every source level by level, then dependencies backwards level by level.
_BETWEEN = """, mult as (select from_key as a, to_key as b, count(*)::double as w from e group by all),
  bfs(s, v, dist) using key (s, v) as (
    select distinct a, a, 0 from mult
    union select x.s, m.b, min(x.dist) + 1 from bfs x join mult m on m.a = x.v where not exists (select 1 from recurring.bfs y where y.s = x.s and y.v = m.b) group by x.s, m.b),
  lev as materialized (select * from bfs),
  paths(s, v, l, sigma) as (
    select s, v, 0, 1.0::double from lev where dist = 0
    union all select x.s, m.b, x.l + 1, sum(x.sigma * m.w) from paths x join mult m on m.a = x.v join lev d on d.s = x.s and d.v = m.b and d.dist = x.l + 1 group by x.s, m.b, x.l),
  sg as materialized (select * from paths),
  back(s, v, l, sigma, delta) as (
    select s, v, l, sigma, 0.0::double from sg where l = (select max(l) from sg)
    union all select g.s, g.v, g.l, g.sigma, coalesce(sum(g.sigma * m.w / t.sigma * (1 + t.delta)), 0)
    from (select distinct l from back) c join sg g on g.l = c.l - 1 left join mult m on m.a = g.v left join back t on t.s = g.s and t.v = m.b group by all),
  btw as (select v as key, sum(delta) as score from back where s <> v group by 1)"""


@query("select v.key, round(coalesce(score, 0), 4) as score from v left join btw using (key)")
def betweenness(spark, d):
    return rounded(graph.betweenness(typed(spark, d)), "score", digits=4)


SQL["betweenness"] = SQL["betweenness"].replace(_PRELUDE, _PRELUDE.rstrip() + _BETWEEN)


_CORE = """, near as (select from_key as key, to_key as other from p union select to_key, from_key from p),
  kc(it, key, c) as (select 0, key, count(*) from near group by key union all
    select it + 1, key, max(least(est, rn)) from (select n.key, o.it, o.c as est, row_number() over (partition by n.key order by o.c desc) as rn from near n join kc o on o.key = n.other where o.it < 40) group by it, key)"""


@query("select key, c as coreness, case when c >= 8 then 'CORE' when c >= 3 then 'MID' else 'PERIPHERAL' end as layer from kc where it = 40")
def coreness(spark, d):
    rows = graph.coreness(typed(spark, d))
    return rows.withColumn("layer", S.core_layer("coreness"))


SQL["coreness"] = SQL["coreness"].replace(_PRELUDE, _PRELUDE.rstrip() + _CORE)


def _communities_sql(passes: int = 10) -> str:
    """The moves of all groups in all passes, one table each; ids are places in key order."""
    out = [
        """, nid as (select key, row_number() over (order by key) - 1 as id, ('0x' || md5(key)[1])::int % 8 as g from v),
  m2 as (select 2.0::double * count(*) as m2 from e),
  nb as materialized (select a.id, a.g, b.id as o, count(*)::double as w from (select from_key as x, to_key as y from e union all select to_key, from_key from e) t join nid a on a.key = t.x join nid b on b.key = t.y group by all),
  s0 as materialized (select id, sum(w) as k, id as c from nb group by id)"""
    ]
    n = 0
    for _ in range(passes):
        for g in range(8):
            out.append(f""", t{n} as (select c, sum(k) as total from s{n} group by c),
  q{n} as (select nb.id, x.c, sum(nb.w) as w from nb join s{n} x on x.id = nb.o where nb.g = {g} group by all),
  b{n} as (select id, c from (select q.id, q.c, row_number() over (partition by q.id order by (select m2 from m2) * q.w - own.k * t.total desc, q.c) as r
    from q{n} q join s{n} own on own.id = q.id join t{n} t on t.c = q.c where q.c <> own.c and (select m2 from m2) * q.w - own.k * t.total > 0) where r = 1),
  s{n + 1} as materialized (select s.id, s.k, coalesce(b.c, s.c) as c from s{n} s left join b{n} b using (id))""")
            n += 1
        out.append(f""", r{n} as (select nb.id, max((x.c = y.c)::int) as inside from nb join s{n} x on x.id = nb.id join s{n} y on y.id = nb.o group by 1),
  s{n + 1} as materialized (select s.id, s.k, case when z.size > 2 and r.inside = 0 then -1 - s.id else s.c end as c from s{n} s join (select c, count(*) as size from s{n} group by c) z using (c) join r{n} r on r.id = s.id)""")
        n += 1
    return "".join(out) + f""", com as (select key, dense_rank() over (order by first) - 1 as community from (select nid.key, min(nid.key) over (partition by s.c) as first from s{n} s join nid using (id)))"""


@query("select key, community from com")
def communities(spark, d):
    return C.communities(typed(spark, d))


SQL["communities"] = SQL["communities"].replace(_PRELUDE, _PRELUDE.rstrip() + _communities_sql())


_LABELS = ", near as (select from_key as key, to_key as other from p union select to_key, from_key from p), l0 as (select distinct key, key as label from near)" + "".join(
    f", l{i} as (select key, label from (select n.key, l.label, count(*) as c from near n join l{i - 1} l on l.key = n.other group by all) qualify row_number() over (partition by key order by c desc, label) = 1)" for i in range(1, 11)
)


@query("select key, label from l10")
def label_clusters(spark, d):
    return C.label_clusters(typed(spark, d))


@query("""select row_number() over (order by entity_count desc, label)::int as cluster_id, label, entity_count, internal_edges, external_edges from (
       select s.label, s.entity_count, coalesce(sum(x.i), 0)::bigint as internal_edges, coalesce(sum(x.e), 0)::bigint as external_edges
       from (select label, count(*) as entity_count from l10 group by 1) s left join (
         select a.label, (a.label = b.label)::int as i, (a.label <> b.label)::int as e from p join l10 a on a.key = p.from_key join l10 b on b.key = p.to_key
         union all select b.label, 0, 1 from p join l10 a on a.key = p.from_key join l10 b on b.key = p.to_key where a.label <> b.label) x on x.label = s.label group by all)""")
def clusters(spark, d):
    return C.cluster_edges(typed(spark, d), C.label_clusters(typed(spark, d)))


@query("""select round(coalesce(sum(n - o * i / m) / (2 * m), 0), 6) as modularity from (select count(*)::double as m from e), (
       select c, sum(o) as o, sum(i) as i, sum(n) as n from (
         select a.label as c, count(*) as o, 0 as i, 0 as n from e join l10 a on a.key = e.from_key group by 1
         union all select a.label, 0, count(*), 0 from e join l10 a on a.key = e.to_key group by 1
         union all select a.label, 0, 0, count(*) from p join l10 a on a.key = p.from_key join l10 b on b.key = p.to_key where a.label = b.label group by 1) group by c) group by m""")
def modularity(spark, d):
    labels = C.label_clusters(typed(spark, d)).withColumnRenamed("label", "community")
    return rounded(C.modularity(typed(spark, d), labels), "modularity")


for _q in ("label_clusters", "clusters", "modularity"):
    SQL[_q] = SQL[_q].replace(_PRELUDE, _PRELUDE.rstrip() + _LABELS)


# ---- metrics -----------------------------------------------------------------------------------------------------

_CK = """, cbo as (select key, count(distinct other) as cbo from (select from_key as key, to_key as other from p union all select to_key, from_key from p) group by 1),
  rfc as (select key, count(distinct t) as rfc from (select from_key as key, to_key as t from p union all select a.from_key, b.to_key from p a join p b on b.from_key = a.to_key) group by 1),
  wmc as (select from_key as key, count(*) as wmc from e group by 1),
  kids as (select from_key, to_key, row_number() over (partition by from_key order by to_key, edge_type) as i from e),
  shared as (select a.from_key, a.i as i, b.i as j from kids a join p pa on pa.from_key = a.to_key join p pb on pb.to_key = pa.to_key join kids b on b.from_key = a.from_key and b.to_key = pb.from_key and a.i < b.i group by all),
  lcom as (select k.from_key as key, case when k.c < 2 then 0.0 else 1 - coalesce(s.s, 0) / (k.c * (k.c - 1) / 2.0) end as lcom
           from (select from_key, count(*) as c from kids group by 1) k left join (select from_key, count(*)::double as s from shared group by 1) s using (from_key)),
  ck0 as (select v.key, coalesce(cbo, 0) as cbo, coalesce(lcom, 0.0) as lcom, coalesce(rfc, 0) as rfc, coalesce(wmc, 0) as wmc from v left join cbo using (key) left join lcom using (key) left join rfc using (key) left join wmc using (key)),
  ck1 as (select *, case when cbo > 10 then 'FAIL' else 'OK' end as cbo_status, case when lcom > 0.8 then 'FAIL' else 'OK' end as lcom_status,
          case when rfc > 50 then 'WARNING' else 'OK' end as rfc_status, case when wmc > 50 then 'WARNING' else 'OK' end as wmc_status from ck0)"""


@query("""select key, cbo, round(lcom, 6) as lcom, rfc, wmc, cbo_status, lcom_status, rfc_status, wmc_status,
       case when f >= 2 then 'F' when f = 1 or w >= 3 then 'D' when w = 2 then 'C' when w = 1 then 'B' else 'A' end as grade
       from (select *, (cbo_status = 'FAIL')::int + (lcom_status = 'FAIL')::int as f, (rfc_status = 'WARNING')::int + (wmc_status = 'WARNING')::int as w from ck1)""")
def ck_metrics(spark, d):
    return rounded(metrics.ck_metrics(typed(spark, d)), "lcom")


@query("""select key, h as debt_hours, array_to_string(list_filter([case when cbo > 10 then 'CBO' end, case when lcom > 0.8 then 'LCOM' end, case when wmc > 15 then 'WMC' end], lambda x: x is not null), ',') as violations,
       case when h <= 0 then 'NONE' when h <= 4 then 'LOW' when h <= 8 then 'MEDIUM' else 'HIGH' end as severity
       from (select *, (cbo > 10)::int * 4.0::double + (lcom > 0.8)::int * 8.0::double + (wmc > 15)::int * 2.0::double as h from ck0)""")
def sqale_debt(spark, d):
    return metrics.sqale_debt(typed(spark, d)).withColumn("violations", F.array_join("violations", ","))


for _q in ("ck_metrics", "sqale_debt"):
    SQL[_q] = SQL[_q].replace(_PRELUDE, _PRELUDE.rstrip() + _CK)


@query("""select key, round(coalesce(h, 0), 6) + 0.0 as entropy, case when coalesce(h, 0) < 1.0 then 'LOW' when coalesce(h, 0) < 1.4 then 'MODERATE' else 'HIGH' end as level from v left join (
       select key, round(greatest(0.0 - sum(n / t * log2(n / t)), 0.0), 12) as h from (select key, n::double as n, sum(n) over (partition by key)::double as t from (
         select from_key as key, t, sum(c) as n from (select from_key, to_key, max(edge_type) as t, count(*) as c from e group by all) group by all)) group by key) using (key)""")
def edge_entropy(spark, d):
    return rounded(metrics.edge_entropy(typed(spark, d)), "entropy")


_CONTEXT = """, focus as (select key from deg order by n_in * n_out desc, key limit 1),
  far(k, dist) as (select p.to_key, 1 from p join focus f on p.from_key = f.key union select p.to_key, dist + 1 from far join p on p.from_key = far.k where dist < 4),
  cand as (select k, min(r) as r from (select from_key as k, 0 as r from p join focus f on p.to_key = f.key union all select k, dist from far) where k <> (select key from focus) group by k),
  line as (select k, r, 100 + octet_length(encode(k)) // 10 as cost, row_number() over (order by r, k) as i from cand),
  fill(i, used) as (select 0::bigint, 0::bigint union all select l.i, case when f.used + l.cost <= 4000 then f.used + l.cost else f.used end from fill f join line l on l.i = f.i + 1),
  took as (select l.*, row_number() over (order by l.i) as position from line l join fill f on f.i = l.i join fill g on g.i = l.i - 1 where f.used > g.used)"""


@query("""select position::int as position, k as key, case when r = 0 then 1.0 when r = 1 then 0.95 else greatest(0.1, round(0.7 - 0.1 * (r - 1), 6)) end::double as relevance,
       case when r = 0 then 'direct_caller' when r = 1 then 'direct_callee' else 'transitive_depth_' || r end as relevance_type, cost::int as estimated_tokens from took""")
def smart_context(spark, d):
    return rounded(context.smart_context(R.edge_rows(table(spark, d, "edges")), busiest(spark, d, "both")), "relevance")


SQL["smart_context"] = SQL["smart_context"].replace(_PRELUDE, _PRELUDE.rstrip() + _CONTEXT)


# ---- coverage and diagnostics ------------------------------------------------------------------------------------

_WALK = """, w as (select distinct file_path from source_files where not regexp_matches(file_path, '(^|/)(\\.git|target|node_modules|__pycache__|\\.build|vendor|\\.idea|\\.vscode)/')),
  el as (select file_path from w where regexp_matches(file_path, '\\.(rs|py|js|ts|go|java|c|h|cpp|hpp|rb|php|cs|swift)$')),
  pf as (select distinct file_path from n where not starts_with(file_path, 'unresolved') and not starts_with(file_path, 'external'))"""


@query("""select folder_path, 2 as depth, count(*) as total_files, count(*) as eligible_files, count(q) as parsed_files, count(q) * 100.0::double / count(*) as coverage_pct from (
       select el.file_path, pf.file_path as q, array_to_string(list_slice(string_split(regexp_extract(el.file_path, '^(.*)/[^/]*$', 1), '/'), 1, 2), '/') || '/' as folder_path from el left join pf using (file_path)) group by 1""")
def folder_coverage(spark, d):
    return coverage.folder_coverage(table(spark, d, "source_files"), entities(spark, d, "isgl1_key", "file_path"))


@query("""select (select count(*) from w) as total_files, (select count(*) from el) as eligible_files, (select count(*) from pf) as parsed_files,
       (select count(*) from pf) * 100.0::double / (select count(*) from el) as coverage_pct, (select count(*) from n) as entity_count, (select count(*) from e) as edge_count,
       (select count(*) from el where file_path not in (select file_path from pf)) as error_count,
       (select coalesce(string_agg(file_path, ',' order by file_path), '') from (select file_path from el where file_path not in (select file_path from pf) order by 1 limit 100)) as unparsed_files""")
def coverage_summary(spark, d):
    out = coverage.coverage_summary(table(spark, d, "source_files"), entities(spark, d, "isgl1_key", "file_path"), typed(spark, d))
    return out.withColumn("unparsed_files", F.array_join("unparsed_files", ","))


for _q in ("folder_coverage", "coverage_summary"):
    SQL[_q] = SQL[_q].replace(_PRELUDE, _PRELUDE.rstrip() + _WALK)

_WORDS = r""", txt as (select file_path, max(coalesce(current_code, '')) as t from source_files group by 1),
  lang as (select file_path, t, case regexp_extract(file_path, '\.([^./]+)$', 1) when 'rs' then 'rust' when 'js' then 'javascript' when 'jsx' then 'javascript' when 'ts' then 'typescript' when 'tsx' then 'typescript'
       when 'py' then 'python' when 'java' then 'java' when 'go' then 'go' when 'c' then 'c' when 'h' then 'c' when 'rb' then 'ruby' else 'unknown' end as language from txt),
  ls as (select file_path, language, t, string_split(t, chr(10)) as l from lang),
  wc as (select file_path, language, len(regexp_extract_all(t, '\S+')) as source_word_count,
       coalesce(list_sum(list_transform(list_filter(l, lambda x: regexp_matches(x, '^\s*(import\b|from\s+\S+\s+import\b|use\s|#\s*include\b|require\b|using\s)')), lambda x: len(regexp_extract_all(x, '\S+')))), 0)::bigint as import_word_count,
       coalesce(list_sum(list_transform(list_filter(l, lambda x: case when language in ('python', 'ruby') then regexp_matches(x, '^#([^!]|$)') else regexp_matches(x, '^(//|/\*| ?\*)') end), lambda x: len(regexp_extract_all(x, '\S+')))), 0)::bigint as comment_word_count from ls),
  own as (select file_path, sum(len(regexp_extract_all(coalesce(current_code, ''), '\S+')))::bigint as ew, count(*) as ec from n where entity_class = 'CODE' group by 1),
  cov as (select regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder_path, regexp_extract(file_path, '([^/]*)$', 1) as filename, language, source_word_count, coalesce(ew, 0) as entity_word_count, import_word_count, comment_word_count,
       case when source_word_count > 0 then coalesce(ew, 0) * 100.0::double / source_word_count else 100.0 end as raw_coverage_pct,
       case when source_word_count - import_word_count - comment_word_count > 0 then coalesce(ew, 0) * 100.0::double / (source_word_count - import_word_count - comment_word_count) else 100.0 end as effective_coverage_pct,
       coalesce(ec, 0) as entity_count from wc left join own using (file_path))"""


def _words(spark, d):
    return coverage.word_coverage(table(spark, d, "source_files"), entities(spark, d, "isgl1_key", "file_path", "entity_class", "current_code"))


@query("select * exclude (raw_coverage_pct, effective_coverage_pct), round(raw_coverage_pct, 6) as raw_coverage_pct, round(effective_coverage_pct, 6) as effective_coverage_pct from cov")
def word_coverage(spark, d):
    return rounded(_words(spark, d), "raw_coverage_pct", "effective_coverage_pct")


@query("select count(*) as n_files, round(coalesce(avg(raw_coverage_pct), 0), 6) as avg_raw_pct, round(coalesce(avg(effective_coverage_pct), 0), 6) as avg_effective_pct from cov")
def coverage_averages(spark, d):
    return rounded(coverage.coverage_averages(_words(spark, d)), "avg_raw_pct", "avg_effective_pct")


for _q in ("word_coverage", "coverage_averages"):
    SQL[_q] = SQL[_q].replace(_PRELUDE, _PRELUDE.rstrip() + _WORDS)


@query("""select interface_signature->>'name' as entity_name, regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder_path, regexp_extract(file_path, '([^/]*)$', 1) as filename, entity_class, language,
       (interface_signature->'line_range'->>'start')::bigint as line_start, (interface_signature->'line_range'->>'end')::bigint as line_end, 'entity_class is TEST' as detection_reason from n where entity_class = 'TEST'""")
def excluded_tests(spark, d):
    return coverage.excluded_tests(entities(spark, d, "isgl1_key", "file_path", "entity_class", "language", "interface_signature"))


@query(r"""select folder_path, filename, extension, reason from (select regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder_path, regexp_extract(file_path, '([^/]*)$', 1) as filename, regexp_extract(file_path, '\.([^./]+)$', 1) as extension,
       case when regexp_matches(file_path, '(^|/)(\.git|target|node_modules|__pycache__|\.build|vendor|\.idea|\.vscode)/') then 'excluded directory'
            when not regexp_matches(file_path, '\.(rs|py|js|ts|go|java|c|h|cpp|hpp|rb|php|cs|swift)$') then 'unsupported extension' end as reason from (select distinct file_path from source_files)) where reason is not null""")
def ignored_files(spark, d):
    return coverage.ignored_files(table(spark, d, "source_files"))


@query(r"""select regexp_extract(file_path, '\.([^./]+)$', 1) as extension, count(*) as n from (select distinct file_path from source_files)
       where regexp_matches(file_path, '(^|/)(\.git|target|node_modules|__pycache__|\.build|vendor|\.idea|\.vscode)/') or not regexp_matches(file_path, '\.(rs|py|js|ts|go|java|c|h|cpp|hpp|rb|php|cs|swift)$') group by 1""")
def ignored_by_extension(spark, d):
    return coverage.ignored_files(table(spark, d, "source_files")).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


@query("select root_subfolder_l1 as l1, array_to_string(list_sort(list(distinct root_subfolder_l2) filter (root_subfolder_l2 <> '')), ',') as l2_folders, count(*) as n_entities from n group by 1")
def folder_tree(spark, d):
    return coverage.folder_tree(entities(spark, d, "isgl1_key", "root_subfolder_l1", "root_subfolder_l2"))


@query("""select run_at::varchar as run_at, sum(total_files)::bigint as total_files, sum(parsed_files)::bigint as parsed_files, sum(entity_count)::bigint as entity_count, sum(error_count)::bigint as error_count from coverage_reports group by all""")
def ingestion_totals(spark, d):
    rows = table(spark, d, "coverage_reports")
    return rows.groupBy(F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at")).agg(*[F.sum(c).alias(c) for c in ("total_files", "parsed_files", "entity_count", "error_count")])


# ---- temporal state ----------------------------------------------------------------------------------------------


@query("select isgl1_key, future_action from n where future_action is not null")
def changed_entities(spark, d):
    return temporal.changed_entities(entities(spark, d, "isgl1_key", "future_action"))


@query("""select report_id from entity_states where not coalesce(case when not current_ind and not future_ind then false when future_action is null then current_ind = future_ind
       else (current_ind and not future_ind and future_action = 'Delete') or (current_ind and future_ind and future_action = 'Edit') or (not current_ind and future_ind and future_action = 'Create') end, false)""")
def invalid_states(spark, d):
    return temporal.invalid_states(table(spark, d, "entity_states")).select("report_id")


@query("select isgl1_key, case when future_action is not null then future_code else current_code end as current_code, true as current_ind, true as future_ind from n where future_action is distinct from 'Delete'")
def promoted(spark, d):
    rows = entities(spark, d, "isgl1_key", "current_code", "future_code", "current_ind", "future_ind", "future_action")
    return temporal.promote(rows).drop("future_code", "future_action")


_CHANGE_SQL = "(select isgl1_key, future_action as action, report_id as seq, 'v' || report_id as future_code from entity_states where future_action is not null)"


def _changes(spark, d):
    s = table(spark, d, "entity_states").filter("future_action is not null")
    return s.select("isgl1_key", F.col("future_action").alias("action"), F.col("report_id").alias("seq"), F.concat(F.lit("v"), F.col("report_id").cast("string")).alias("future_code"))


@query(f"select isgl1_key, count(*) as n_changes from {_CHANGE_SQL} group by 1 having count(*) > 1")
def change_conflicts(spark, d):
    return temporal.change_conflicts(_changes(spark, d))


@query(f"select * from {_CHANGE_SQL} qualify row_number() over (partition by isgl1_key order by seq desc) = 1")
def latest_changes(spark, d):
    return temporal.resolve_conflicts(_changes(spark, d))


@query(f"select * from {_CHANGE_SQL} qualify row_number() over (partition by isgl1_key order by seq) = 1")
def earliest_changes(spark, d):
    return temporal.resolve_conflicts(_changes(spark, d), "earliest")


_APPLY = f""", ch as (select * from {_CHANGE_SQL} qualify row_number() over (partition by isgl1_key order by seq desc) = 1),
  ap as (select isgl1_key, n.isgl1_key is not null as known, n.current_ind, n.future_ind, n.future_action, n.future_code, ch.action, ch.future_code as new_code from n full join ch using (isgl1_key)),
  ap1 as (select *, case when not known and action in ('Edit', 'Delete') then 'no such entity' when known and current_ind and action = 'Create' then 'entity exists already' end as error
          from (select a.* replace (b.known as known) from ap a join (select isgl1_key, exists (select 1 from n where n.isgl1_key = ap.isgl1_key) as known from ap) b using (isgl1_key)))"""


def _applied(spark, d):
    rows = entities(spark, d, "isgl1_key", "current_code", "future_code", "current_ind", "future_ind", "future_action")
    return temporal.apply_changes(rows, temporal.resolve_conflicts(_changes(spark, d)))


@query("""select isgl1_key, case when action is not null and error is null then action <> 'Create' else current_ind end as current_ind, case when action is not null and error is null then action <> 'Delete' else future_ind end as future_ind,
       case when action is not null and error is null then action else future_action end as future_action, case when action is not null and error is null then case when action <> 'Delete' then new_code end else future_code end as future_code
       from ap1 where known or error is null""")
def applied_changes(spark, d):
    return _applied(spark, d)[0].drop("current_code")


@query("select isgl1_key, action, error from ap1 where error is not null")
def rejected_changes(spark, d):
    return _applied(spark, d)[1]


for _q in ("applied_changes", "rejected_changes"):
    SQL[_q] = SQL[_q].replace(_PRELUDE, _PRELUDE.rstrip() + _APPLY)


# ---- keys, matching, placeholders --------------------------------------------------------------------------------


@query("""select to_key as isgl1_key, split_part(to_key, ':', 1) as language, case split_part(to_key, ':', 2) when 'fn' then 'function' else split_part(to_key, ':', 2) end as entity_type, split_part(to_key, ':', 3) as entity_name,
       case when split_part(to_key, ':', 4) <> 'unresolved-reference' then regexp_replace(split_part(to_key, ':', 4), '^external-dependency-', '') end as crate_name
       from (select distinct to_key from e) where len(string_split(to_key, ':')) = 5 and split_part(to_key, ':', 5) = '0-0' and (split_part(to_key, ':', 4) = 'unresolved-reference' or regexp_matches(split_part(to_key, ':', 4), '^external-dependency-.+'))""")
def placeholder_entities(spark, d):
    return matching.placeholder_entities(typed(spark, d))


@query("""select e.from_key, coalesce(t.target, e.to_key) as to_key, e.edge_type from e left join (
       select language, split_part(isgl1_key, ':', 3) as name, min(isgl1_key) as target from n where entity_type in ('function', 'method') group by all having count(*) = 1) t
       on split_part(e.to_key, ':', 4) = 'unresolved-reference' and t.language = split_part(e.to_key, ':', 1) and t.name = split_part(e.to_key, ':', 3)""")
def resolved_names(spark, d):
    return matching.resolve_names(typed(spark, d), entities(spark, d, "isgl1_key", "entity_type", "language"))


_SIGNED = "select isgl1_key, split_part(isgl1_key, ':', 3) as name, file_path, (interface_signature->'line_range'->>'start')::int as line_start, (interface_signature->'line_range'->>'end')::int as line_end, content_hash, coalesce(birth_timestamp, 0) as b, entity_type from n"


def _signed(spark, d):
    rng = F.from_json("interface_signature", "struct<line_range:struct<start:int,end:int>>")["line_range"]
    rows = entities(spark, d, "isgl1_key", "file_path", "interface_signature", "content_hash", "birth_timestamp", "entity_type")
    return rows.select("isgl1_key", S.name_of_key("isgl1_key").alias("name"), "file_path", rng["start"].alias("line_start"), rng["end"].alias("line_end"), "content_hash", F.coalesce("birth_timestamp", F.lit(0)).alias("b"), "entity_type")


@query(f"""select a.isgl1_key, min(case when o.content_hash = a.h then o.isgl1_key end) is not null as by_content,
       coalesce(min(case when o.content_hash = a.h then o.isgl1_key end), min(case when abs(a.s - o.line_start) <= 10 then o.isgl1_key end)) as old_key,
       case when min(case when o.content_hash = a.h then 1 end) = 1 then 'content' when min(case when abs(a.s - o.line_start) <= 10 then 1 end) = 1 then 'position' else 'new' end as match
       from (select isgl1_key, name, file_path, line_start + b % 25 as s, case when b % 2 = 0 then content_hash else 'edited' end as h from ({_SIGNED})) a left join ({_SIGNED}) o on o.name = a.name and o.file_path = a.file_path group by a.isgl1_key""")
def matched_entities(spark, d):
    """Every entity, moved by up to 24 lines and half of them edited, against the index of before."""
    old = _signed(spark, d).withColumnRenamed("isgl1_key", "key")
    new = _signed(spark, d).withColumns({"line_start": (F.col("line_start") + F.col("b") % 25).cast("int"), "content_hash": F.when(F.col("b") % 2 == 0, F.col("content_hash")).otherwise("edited")})
    m = matching.match_entities(new, old)
    return m.select("isgl1_key", (F.col("match") == "content").alias("by_content"), "old_key", "match")


@query(f"""select site_id, isgl1_key from (select s.site_id, x.isgl1_key, row_number() over (partition by s.site_id order by x.line_end - x.line_start, case when x.entity_type in ('function', 'method') then 0 else 1 end, x.isgl1_key) as r
       from (select distinct source_location as site_id, regexp_replace(source_location, ':[0-9]+$', '') as file_path, regexp_extract(source_location, ':([0-9]+)$', 1)::int as line from edges where source_location is not null) s
       left join ({_SIGNED}) x on x.file_path = s.file_path and s.line between x.line_start and x.line_end) where r = 1""")
def containing_entities(spark, d):
    """The entity around every place that edges name."""
    loc = F.col("source_location")
    sites = table(spark, d, "edges").filter(loc.isNotNull()).select(loc.alias("site_id"), F.regexp_replace(loc, r":\d+$", "").alias("file_path"), F.regexp_extract(loc, r":(\d+)$", 1).cast("int").alias("line")).distinct()
    return matching.containing_entity(sites, _signed(spark, d))


@query(r"""select isgl1_key, split_part(isgl1_key, ':', 1) as language, split_part(isgl1_key, ':', 3) as name, '__' || translate(regexp_replace(file_path, '\.[^.]*$', ''), '/\-.', '____') as semantic_path, translate(file_path, '/\.', '___') as flat_path,
       regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(file_path, '([^/]*)$', 1) as filename, string_split(file_path, '/')[1] as l1, case when len(string_split(file_path, '/')) > 2 then string_split(file_path, '/')[2] else '' end as l2,
       (100 + floor(octet_length(encode(isgl1_key)) / 10))::int as tokens, sha256(isgl1_key) as hash from n""")
def key_and_path_functions(spark, d):
    rows = entities(spark, d, "isgl1_key", "file_path")
    return rows.select(
        "isgl1_key", S.language_of_key("isgl1_key").alias("language"), S.name_of_key("isgl1_key").alias("name"), S.semantic_path("file_path").alias("semantic_path"), S.sanitize_path("file_path").alias("flat_path"), S.folder_of("file_path").alias("folder"),
        S.filename_of("file_path").alias("filename"), S.subfolder_l1("file_path").alias("l1"), S.subfolder_l2("file_path").alias("l2"), S.estimated_tokens("isgl1_key").alias("tokens"), S.content_hash("isgl1_key").alias("hash"),
    )


@query("""select isgl1_key, interface_signature->>'name' as name, interface_signature->>'visibility' as visibility, (interface_signature->'line_range'->>'end')::int - (interface_signature->'line_range'->>'start')::int + 1 as span,
       tdd_classification->>'complexity' as complexity, (tdd_classification->>'dependencies')::bigint as dependencies from n""")
def signature_fields(spark, d):
    from edgewright.schemas import SIGNATURE, TDD

    rows = entities(spark, d, "isgl1_key", "interface_signature", "tdd_classification").select("isgl1_key", F.from_json("interface_signature", SIGNATURE).alias("s"), F.from_json("tdd_classification", TDD).alias("t"))
    return rows.select("isgl1_key", "s.name", "s.visibility", S.line_span("s.line_range.start", "s.line_range.end").alias("span"), "t.complexity", "t.dependencies")


@query(r"""select distinct file_id, case when file_path like '%main.rs' or file_path like '%lib.rs' then false when language = 'rust' then file_path like '%/tests/%' or file_path like 'tests/%' or file_path like '%\_test.rs' escape '\' or file_path like '%\_tests.rs' escape '\' or contains(t, '#[test]') or contains(t, '#[cfg(test)]')
       when language = 'go' then file_path like '%\_test.go' escape '\' when language in ('javascript', 'typescript') then contains(file_path, '.test.') or contains(file_path, '.spec.') or contains(file_path, '__tests__')
       when language = 'python' then starts_with(file_path, 'test_') or contains(file_path, '/test_') or file_path like '%\_test.py' escape '\' or contains(file_path, '/tests/') when language = 'java' then file_path like '%Test.java' or file_path like '%Tests.java' or contains(file_path, 'src/test/') else false end as is_test
       from (select *, coalesce(current_code, '') as t from source_files)""")
def test_files(spark, d):
    rows = table(spark, d, "source_files")
    return rows.select("file_id", S.is_test_file("file_path", "current_code", "language").alias("is_test")).distinct()


# ---- writing, incremental state, documents -----------------------------------------------------------------------


@query("select from_key, to_key, edge_type from e")
def upserted_edges(spark, d):
    """All deliveries put into the relation of those that are Uses."""
    rows = table(spark, d, "edges").select("from_key", "to_key", "edge_type", "source_location")
    target = R.edge_relation(rows.filter("edge_type = 'Uses'"))
    return R.upsert_edges(target, rows).select("from_key", "to_key", "edge_type")


@query("select from_key, to_key, edge_type from e where from_key not in (select isgl1_key from n where removed_at is not null)")
def edges_without_removed(spark, d):
    gone = entities(spark, d, "isgl1_key", "removed_at").filter("removed_at is not null").select("isgl1_key")
    return R.delete_edges_from(typed(spark, d), gone)[0]


@query("select isgl1_key from n where isgl1_key not in (select isgl1_key from n where removed_at is not null)")
def entities_without_removed(spark, d):
    rows = entities(spark, d, "isgl1_key", "removed_at")
    return R.delete_by_keys(rows, rows.filter("removed_at is not null").select("isgl1_key"), "isgl1_key").select("isgl1_key")


@query("""select file_path, sha256(current_code) as content_hash from (select * from source_files qualify row_number() over (partition by file_path order by loaded_at desc, file_id desc) = 1) f
       where current_code is not null and not exists (select 1 from n where n.entity_type = 'module' and n.file_path = f.file_path and n.content_hash = sha256(f.current_code))""")
def changed_files(spark, d):
    """Files whose text has another hash than the one cached for them (that of their module)."""
    from edgewright.streaming.reindex import unchanged

    files = R.latest(table(spark, d, "source_files"), ["file_path"], F.desc("loaded_at"), F.desc("file_id")).filter("current_code is not null").select("file_path", F.col("current_code").alias("content"))
    cache = entities(spark, d, "isgl1_key", "file_path", "content_hash", "entity_type").filter("entity_type = 'module'")
    same = unchanged(files, cache).select("file_path").distinct()
    return files.join(same, "file_path", "left_anti").select("file_path", S.content_hash("content").alias("content_hash"))


@query("select isgl1_key as file_path, report_id, n_events from (select *, count(*) over (partition by isgl1_key) as n_events from entity_states) qualify row_number() over (partition by isgl1_key order by effective_at desc, report_id::varchar desc) = 1")
def debounced_events(spark, d):
    from edgewright.streaming.reindex import debounced

    rows = table(spark, d, "entity_states").select(F.col("isgl1_key").alias("file_path"), F.col("report_id").cast("string").alias("change_type"), F.col("effective_at").alias("changed_at"), "report_id")
    return debounced(rows).select("file_path", "report_id", "n_events")


@query("select from_key, to_key, edge_type from e where edge_type = 'Calls' and from_key in (select isgl1_key from n)")
def json_document_edges(spark, d):
    """The graph written as JSON documents per file and read again: its calls."""
    docs = json_graph.graph_document(entities(spark, d, "isgl1_key", "file_path"), typed(spark, d))
    return json_graph.doc_edges(docs, "Calls")


@query("""select 0 as part, 'languages[' || (select count(distinct language) from n) || '\\t]{entities,functions,language}:' as value union all
       select 1, '  ' || count(*) || chr(9) || count(*) filter (entity_type = 'function') || chr(9) || language from n group by language""")
def tabular_text(spark, d):
    rows = entities(spark, d, "isgl1_key", "language", "entity_type").groupBy("language").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("entity_type") == "function").alias("functions"))
    return sink.tabular(rows, "languages")


@query("""select '[UNPARSED] ' || file_path as value from (select distinct file_path from source_files) where file_path not in (select file_path from n)""")
def error_log_lines(spark, d):
    rows = table(spark, d, "source_files").select("file_path").distinct().join(entities(spark, d, "isgl1_key", "file_path").select("file_path").distinct(), "file_path", "left_anti")
    return sink.error_log(rows.select("file_path", F.lit("UNPARSED").alias("tag"), F.lit("").alias("detail")))


@query()
def extracted_entity_counts(spark, d):
    rows = extraction.extracted_entities(table(spark, d, "source_files"))
    return rows.groupBy("language", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def extracted_edges(spark, d):
    return extraction.extracted_edges(table(spark, d, "source_files"))


#: Small sources, one per language, with what is to be found in them.
_SAMPLES = {
    "s/a.rs": "use clap::Parser;\nuse std::collections::HashMap;\nuse crate::y as z;\nstruct S { a: Foo, b: Vec<Bar> }\nimpl Tr for S {\n    fn f(&self, q: Baz) -> Qux {\n        run(1)\n    }\n}\n",
    "s/b.js": "import a from './x';\nconst f = (x) => g(x);\nconst h = async function(a) {\n  return a.b.c(1);\n};\nclass A {\n  m(a) { return this.p; }\n}\n",
    "s/c.ts": "const f = async (x: number): Promise<string> => { return g(x); };\ninterface I { a: Map<string, B>; }\n",
    "s/d.py": "from x.y import z\n@app.route\ndef f(a: Foo) -> Bar:\n    return g(a.b)\n",
    "s/e.go": "package a\n\nimport \"fmt\"\n\nfunc F(a int) int {\n\treturn fmt.Sum(a)\n}\n",
}
_SAMPLE_ENTITIES = [
    ("s/a.rs", "impl", "S", 5, 9), ("s/a.rs", "method", "f", 6, 8), ("s/a.rs", "struct", "S", 4, 4), ("s/b.js", "class", "A", 6, 8), ("s/b.js", "function", "f", 2, 2), ("s/b.js", "function", "h", 3, 5), ("s/b.js", "method", "m", 7, 7),
    ("s/c.ts", "function", "f", 1, 1), ("s/c.ts", "interface", "I", 2, 2), ("s/d.py", "function", "f", 3, 4), ("s/e.go", "function", "F", 5, 7),
]
_SAMPLE_EDGES = [
    ("rust", "S", "Implements", "rust:fn:Tr:unresolved-reference:0-0"), ("rust", "f", "Calls", "rust:fn:run:unresolved-reference:0-0"), ("javascript", "f", "Calls", "javascript:fn:g:unresolved-reference:0-0"), ("javascript", "h", "Calls", "javascript:fn:c:unresolved-reference:0-0"),
    ("typescript", "f", "Calls", "typescript:fn:g:unresolved-reference:0-0"), ("python", "f", "Calls", "python:fn:g:unresolved-reference:0-0"), ("go", "F", "Calls", "go:fn:Sum:unresolved-reference:0-0"),
] + [
    (lang, path, "Uses", f"{lang}:module:{name}:0-0")
    for lang, path, names in (
        ("rust", "s_a_rs", "Parser:external-dependency-clap Parser std__collections__HashMap HashMap y Foo Bar Baz Qux"), ("javascript", "s_b_js", "./x b c p"), ("typescript", "s_c_ts", "Promise Map"), ("python", "s_d_py", "x.y route Foo Bar b"), ("go", "s_e_go", "fmt"),
    )
    for name in names.split()
]


def _samples(spark):
    return spark.createDataFrame(list(_SAMPLES.items()), "file_path string, current_code string")


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


@query(f"select * from {_values(_SAMPLE_ENTITIES)} t(file_path, entity_type, name, line_start, line_end)")
def extracted_sample_entities(spark, d):
    """What extraction finds in the small sources."""
    return extraction.extracted_entities(_samples(spark)).drop("language")


@query(f"select * from {_values(_SAMPLE_EDGES)} t(language, source, edge_type, to_key)")
def extracted_sample_edges(spark, d):
    rows = extraction.extracted_edges(_samples(spark))
    return rows.select(S.language_of_key("from_key").alias("language"), S.name_of_key("from_key").alias("source"), "edge_type", "to_key")


@query("select 'rust:module:Parser:external-dependency-clap:0-0' as isgl1_key, 'rust' as language, 'module' as entity_type, 'Parser' as entity_name, 'clap' as crate_name")
def extracted_sample_placeholders(spark, d):
    """Records for what the small sources use from outside."""
    return matching.placeholder_entities(extraction.extracted_edges(_samples(spark)).filter("to_key like '%external-dependency%'"))


@query(r"""select file_id, (i + 2 * (row_number() over (partition by file_id order by i) - 1))::int as line, name from (
       select file_id, i, l[i] as t, regexp_extract(l[i], '^(pub )?fn\s+(\w+)', 2) as name from (select file_id, string_split(any_value(current_code), chr(10)) as l from source_files where current_code is not null and language = 'rust' group by 1), unnest(generate_series(1, len(l))) u(i))
       where regexp_matches(t, '^(pub )?fn ') qualify name <> ''""")
def test_functions(spark, d):
    """Every function of the outermost level of Rust files, marked as a test by a line of its own and a blank one."""
    files = R.latest(table(spark, d, "source_files"), ["file_id"], F.desc("loaded_at")).filter("current_code is not null and language = 'rust'")
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col("current_code")), "\n(pub |)fn ", "\n#[test]\n\n$1fn ")
    return matching.next_function(files.select("file_id", F.substring(marked, 2, 2**31 - 1).alias("current_code")))


@query("""select (row_number() over (order by step) - 1)::int as position, k as key from (with recursive w(k, step, seen) as (
         select key, 0, [key] from deg where key = (select key from deg order by n_in * n_out desc, key limit 1)
         union all select c.t, step + 1, list_append(seen, c.t) from w join (select from_key, min(to_key) as t from e where edge_type = 'Calls' group by 1) c on c.from_key = w.k where not list_contains(seen, c.t))
       select k, step from w)""")
def call_chain(spark, d):
    chain = json_graph.call_chain(typed(spark, d), busiest(spark, d, "both"))
    return spark.createDataFrame([(i, k) for i, k in enumerate(chain)], "position int, key string")


@query()
def reindexed_files(spark, d):
    """The whole source tree indexed as a first batch, then every file delivered again, every other one without its last line."""
    return _reindexed(spark, d)


@query(r"""select file_path, 1::bigint as n_events, not coalesce(current_code is not null and (file_id % 2 = 1 or regexp_replace(current_code, '\n[^\n]*\n?$', '') = current_code), false) as hash_changed, true as adds_up
       from (select * from source_files qualify row_number() over (partition by file_path order by loaded_at desc, file_id desc) = 1)""")
def reindexed_hashes(spark, d):
    """Which of the files delivered again had changed, and whether the counts of their entities add up."""
    m = _reindexed(spark, d)
    return m.select("file_path", "n_events", "hash_changed", (F.col("entities_after") == F.col("entities_before") - F.col("entities_removed") + F.col("entities_added")).alias("adds_up"))


def _reindexed(spark, d):
    from edgewright.streaming.reindex import reindex

    files = R.latest(table(spark, d, "source_files"), ["file_path"], F.desc("loaded_at"), F.desc("file_id")).select("file_path", F.lit("Modified").alias("change_type"), F.col("current_code").alias("content"), F.col("loaded_at").alias("changed_at"), "file_id")
    empty = spark.createDataFrame([], "isgl1_key string, name string, file_path string, line_start int, line_end int, content_hash string, entity_type string, language string")
    first = reindex(empty, spark.createDataFrame([], "from_key string, to_key string, edge_type string, source_location string"), spark.createDataFrame([], "file_path string, content_hash string"), files.drop("file_id"))
    again = files.withColumn("content", F.when(F.col("file_id") % 2 == 0, F.regexp_replace("content", r"\n[^\n]*\n?$", "")).otherwise(F.col("content"))).drop("file_id")
    return reindex(cut(first.entities), cut(first.edges), cut(first.cache), again).metrics


_ENDPOINTS = """, hk as (select key as k, octet_length(encode(key)) as b from hot_in), ho as (select key as k, octet_length(encode(key)) as b from hot_out),
  det as (select octet_length(encode(current_code)) as b from n where isgl1_key = (select min(isgl1_key) from n where current_code is not null)),
  back(k, hop) as (select key, 0 from hot_in union select p.from_key, hop + 1 from back join p on p.to_key = back.k
    or (regexp_matches(p.to_key, '^rust:(fn|method):') and split_part(p.to_key, ':', 3) = split_part(back.k, ':', 3) and split_part(back.k, ':', 3) <> '') where hop < 3),
  fo as (select key from hot_out), f2(k, dist) as (select p.to_key, 1 from p join fo on p.from_key = fo.key union select p.to_key, dist + 1 from f2 join p on p.from_key = f2.k where dist < 4),
  cand as (select k, min(r) as r from (select from_key as k, 0 as r from p join fo on p.to_key = fo.key union all select k, dist from f2) where k <> (select key from fo) group by k),
  line as (select k, 100 + octet_length(encode(k)) // 10 as cost, row_number() over (order by r, k) as i from cand),
  fill(i, used) as (select 0::bigint, 0::bigint union all select l.i, case when f.used + l.cost <= 4000 then f.used + l.cost else f.used end from fill f join line l on l.i = f.i + 1)"""


@query("""select '/codebase-statistics-overview-summary' as endpoint, 50::bigint as tokens union all
  select '/code-entities-list-all', 50 + 20 * count(*) from n where entity_type = 'function' union all
  select '/code-entity-detail-view', 100 + b from det union all
  select '/code-entities-search-fuzzy', 66 + 20 * count(*) from n where contains(lower(isgl1_key), 'walker') union all
  select '/reverse-callers-query-graph', 80 + 50 * count(*) + (select b from hk) from (select distinct e.* from e, hot_in h where to_key = h.key or starts_with(to_key, 'rust:fn:' || split_part(h.key, ':', 3) || ':') or starts_with(to_key, 'rust:method:' || split_part(h.key, ':', 3) || ':')) union all
  select '/forward-callees-query-graph', 80 + 50 * count(*) + (select b from ho) from e where from_key = (select key from hot_out) union all
  select '/dependency-edges-list-all', 60 + 40 * least(100, count(*)) from e union all
  select '/blast-radius-impact-analysis', 80 + 30 * (count(distinct k) - 1) + (select b from hk) from back union all
  select '/complexity-hotspots-ranking-view', 80 + 25 * least(10, count(*)) from v union all
  select '/semantic-cluster-grouping-list', 80 + 30 * (select count(distinct label) from l10) + (select sum(octet_length(encode(key))) from l10) // 4 union all
  select '/smart-context-token-budget', 100 + 40 * (count(distinct used) - 1) from fill union all
  select '/strongly-connected-components-analysis', 50 + 30 * count(distinct component) + 15 * count(*) from scc union all
  select '/technical-debt-sqale-scoring', 60 + 40 * count(*) + 25 * sum((cbo > 10)::int + (lcom > 0.8)::int + (wmc > 15)::int)::bigint from ck0 union all
  select '/kcore-decomposition-layering-analysis', 50 + 25 * count(*) from v union all
  select '/centrality-measures-entity-ranking', 50 + 30 * least(20, count(*)) from v union all
  select '/entropy-complexity-measurement-scores', 50 + 25 * count(*) from v union all
  select '/coupling-cohesion-metrics-suite', 50 + 35 * count(*) from v union all
  select '/leiden-community-detection-clusters', 60 + 25 * count(distinct community) + 15 * count(*) from com union all
  select '/ingestion-coverage-folder-report', 100 + 40 * (select count(distinct array_to_string(list_slice(string_split(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '/'), 1, 2), '/')) from el) + 10 * (select count(*) from el where file_path not in (select file_path from pf)) union all
  select '/ingestion-diagnostics-coverage-report', 100 + 30 * (select count(*) from n where entity_class = 'TEST') + 50 * (select count(*) from cov) + 20 * (select count(distinct file_path) from source_files where file_path not in (select file_path from el)) union all
  select '/folder-structure-discovery-tree', 100 + 30 * count(distinct root_subfolder_l1) from n""")
def endpoint_tokens(spark, d):
    """Every read endpoint asked once, with its cost hint (but that of cycles, which depends on those found)."""
    from edgewright.plans.endpoints import Service

    s = Service(spark, table(spark, d, "entities"), table(spark, d, "edges"), table(spark, d, "source_files"))
    hub, source = s.busiest("in"), s.busiest("out")
    detail = s.entities("isgl1_key", "current_code").dropna().agg(F.min("isgl1_key")).first()[0]
    asked = [
        s.statistics(), s.list_entities("function"), s.entity_detail(detail), s.search("walker"), s.callers(hub), s.callees(source), s.list_edges(), s.blast_radius(hub), s.hotspots(), s.clusters(), s.smart_context(source),
        s.components(), s.debt(), s.kcore(), s.centrality(top=20), s.entropy(), s.coupling(), s.communities(), s.folder_coverage(), s.diagnostics(), s.folder_tree(),
    ]
    return spark.createDataFrame([(a.endpoint, a.tokens) for a in asked], "endpoint string, tokens long")


SQL["endpoint_tokens"] = SQL["endpoint_tokens"].replace(_PRELUDE, _PRELUDE.rstrip() + _SCC + _LABELS + _CK + _WALK + _WORDS + _communities_sql() + _ENDPOINTS)


@query("""select count(*) filter (entity_class = 'TEST') as test_entities_count, (select count(*) from cov) as total_files_with_coverage, round((select avg(raw_coverage_pct) from cov), 6) as avg_raw_coverage_pct,
       round((select avg(effective_coverage_pct) from cov), 6) as avg_effective_coverage_pct, (select count(distinct file_path) from source_files where file_path not in (select file_path from el)) as ignored_files_count from n""")
def diagnostics_summary(spark, d):
    """The summary section of the diagnostics report."""
    from edgewright.plans.endpoints import Service

    s = Service(spark, table(spark, d, "entities"), table(spark, d, "edges"), table(spark, d, "source_files"))
    return rounded(s.diagnostics("summary").data, "avg_raw_coverage_pct", "avg_effective_coverage_pct")


SQL["diagnostics_summary"] = SQL["diagnostics_summary"].replace(_PRELUDE, _PRELUDE.rstrip() + _WALK + _WORDS)
