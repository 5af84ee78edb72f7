"""Registered queries of the record-level problems 1, 2, 4 and 6, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.operators.history import state_versions
from edgewright.operators.hotkeys import heavy_pairs, key_statistics
from edgewright.operators.orphans import orphan_cascade, orphan_references, orphan_report
from edgewright.operators.snapshots import snapshot_changes
from edgewright.sources.tables import table


def _graph(spark, d):
    return table(spark, d, "edges"), table(spark, d, "entities"), table(spark, d, "external_entities")


def p1_found(spark, d):
    return orphan_references(*_graph(spark, d)).select("edge_id", "side")


def p1_orphan_report(spark, d):
    return orphan_report(*_graph(spark, d))


def p1_orphan_cascade(spark, d):
    return orphan_cascade(*_graph(spark, d))


def p2_found(spark, d):
    return snapshot_changes(table(spark, d, "entity_snapshots"))


def p2_change_counts(spark, d):
    return p2_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def p4_versions(spark, d):
    v, stamp = state_versions(table(spark, d, "entity_states")), "yyyy-MM-dd HH:mm:ss"
    return v.withColumns({c: F.date_format(c, stamp) for c in ("valid_from", "valid_to")} | {"birth_timestamp": F.col("birth_timestamp").cast("string")})


def p4_found(spark, d):
    return p4_versions(spark, d).select("isgl1_key", "valid_from")


def p6_key_statistics(spark, d):
    return key_statistics(table(spark, d, "edges"))


def p6_found(spark, d):
    return heavy_pairs(table(spark, d, "edges"))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_report, p1_orphan_cascade, p2_found, p2_change_counts, p4_found, p4_versions, p6_found, p6_key_statistics)}

_ORPHANS = """refs as (
  select edge_id, 'from' side, from_key as key, observed_at from edges
  union all select edge_id, 'to', to_key, observed_at from edges),
orphans as (
  select * from refs r
  where not exists (select 1 from external_entities x where x.isgl1_key = r.key)
    and not exists (select 1 from entities e where e.isgl1_key = r.key and e.first_seen_at <= r.observed_at
                    and (e.removed_at is null or e.removed_at > r.observed_at)))"""

_CASCADE = """ks as (select distinct isgl1_key as k from entities),
  pairs as (select distinct from_key as f, to_key as t from edges where from_key in (select k from ks)),
  walk as (
    select distinct e.from_key as k, 0 as depth from orphans o join edges e using (edge_id) where o.side = 'to' and e.from_key in (select k from ks)
    union
    select p.f, w.depth + 1 from walk w join pairs p on p.t = w.k where w.depth < 40)"""

_CHANGES = """once as (
  select snapshot_no as no, trim(isgl1_key) as key,
         arg_max(coalesce(nullif(regexp_replace(lower(trim(content_hash)), '^0+(.)', '\\1'), ''), '-'), (delivered_at, coalesce(content_hash, ''))) as h
  from entity_snapshots group by all),
nos as (select no, lag(no) over (order by no) as prev from (select distinct no from once)),
paired as (
  select n.no as snapshot_no, coalesce(a.key, b.key) as isgl1_key,
         case when b.key is null then 'added' when a.key is null then 'removed'
              when a.h <> b.h and a.h <> '-' and b.h <> '-' then 'changed' end as change_kind
  from nos n join (
    select n.no, o.key as k from nos n join once o on o.no in (n.no, n.prev) where n.prev is not null group by all) ks on ks.no = n.no
  left join once a on a.no = n.no and a.key = ks.k
  left join once b on b.no = n.prev and b.key = ks.k),
changes as (select * from paired where change_kind is not null)"""

_VERSIONS = """once as (
  select * from entity_states
  qualify row_number() over (partition by isgl1_key, effective_at order by received_at desc, report_id desc) = 1),
marked as (
  select *, (current_ind, future_ind, coalesce(future_action, '~'), coalesce(birth_timestamp, -1)) as s,
         lag((current_ind, future_ind, coalesce(future_action, '~'), coalesce(birth_timestamp, -1))) over (partition by isgl1_key order by effective_at) as p
  from once),
starts as (select * from marked where p is null or p <> s)"""

SQL = {
    "p1_found": f"with {_ORPHANS} select edge_id, side from orphans",
    "p1_orphan_report": f"""with recursive {_ORPHANS}, {_CASCADE},
        told as (select side, key, observed_at, 'direct' as kind from orphans
          union all select r.side, r.key, r.observed_at, 'inherited' from refs r where r.key in (select k from walk)
            and not exists (select 1 from orphans o where o.edge_id = r.edge_id and o.side = r.side))
        select side, case when regexp_matches(key, ':(unresolved-reference|external-dependency-[^:]*):0-0$') then 'external_entities' else 'entities' end as referred_table,
               strftime(date_trunc('week', observed_at), '%Y-%m-%d') as week, kind, count(*) as n_orphans
        from told group by all""",
    "p1_orphan_cascade": f"""with recursive {_ORPHANS}, {_CASCADE}
        select k as isgl1_key, min(depth) as depth, case when min(depth) = 0 then 'direct' else 'inherited' end as kind from walk group by k""",
    "p2_found": f"with {_CHANGES} select snapshot_no, isgl1_key, change_kind from changes",
    "p2_change_counts": f"with {_CHANGES} select snapshot_no, change_kind, count(*) as n from changes group by all",
    "p4_found": f"with {_VERSIONS} select isgl1_key, strftime(effective_at, '%Y-%m-%d %H:%M:%S') as valid_from from starts",
    "p4_versions": f"""with {_VERSIONS}
        select isgl1_key, current_ind, future_ind, future_action, cast(birth_timestamp as varchar) as birth_timestamp, strftime(effective_at, '%Y-%m-%d %H:%M:%S') as valid_from,
               strftime(lead(effective_at) over (partition by isgl1_key order by effective_at), '%Y-%m-%d %H:%M:%S') as valid_to from starts""",
    "p6_found": "select to_key, edge_type from edges group by all having count(*) * 100 >= (select count(*) from edges)",
    "p6_key_statistics": """select to_key, edge_type, count(*) as n_rows, count(distinct from_key) as n_from_keys,
        min(observed_at) as first_observed_at, max(observed_at) as last_observed_at from edges group by all""",
}
