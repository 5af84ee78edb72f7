"""Problems 1, 2, 4 and 6 on small tables, against plain Python, with nulls, ties, repeats, empty tables and odd columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from edgewright.operators.history import state_versions
from edgewright.operators.hotkeys import heavy_pairs, key_statistics
from edgewright.operators.orphans import orphan_cascade, orphan_references, orphan_report
from edgewright.operators.skew import hot_buckets, salted
from edgewright.operators.snapshots import snapshot_changes

T0 = datetime(2024, 1, 1)
EDGES = "edge_id long, from_key string, to_key string, edge_type string, observed_at timestamp_ntz"
ENTITIES = "isgl1_key string, first_seen_at timestamp_ntz, removed_at timestamp_ntz"
SNAPS = "snapshot_no int, isgl1_key string, content_hash string, delivered_at timestamp_ntz"
STATES = "report_id long, isgl1_key string, current_ind boolean, future_ind boolean, future_action string, birth_timestamp long, effective_at timestamp_ntz, received_at timestamp_ntz"


def day(n):
    return T0 + timedelta(days=n) if n is not None else None


def noisy(df):
    """With columns that clash with the operators' own names, also in another case."""
    return df.select("*", *[F.lit(1).alias(c) for c in ("key", "_salt", "state", "h", "n", "side", "EDGE_ID", "Isgl1_Key")])


def test_orphans(spark):
    ent = spark.createDataFrame([("a", day(1), None), ("a", day(1), None), ("b", day(1), day(5)), ("b", day(8), None), (None, day(1), None), ("c", None, None)], ENTITIES)
    ext = spark.createDataFrame([("x",)], "isgl1_key string")
    rows = [(1, "a", "b", "Calls", day(2)), (2, "a", "b", "Calls", day(5)), (3, "a", "b", "Calls", day(7)), (4, "a", "b", "Calls", day(8)), (5, "a", "x", "Calls", day(0)), (6, "z", None, "Calls", day(2)), (7, "c", "x", "Calls", None), (2, "a", "b", "Calls", day(5))]
    got = sorted((r.edge_id, r.side) for r in orphan_references(noisy(spark.createDataFrame(rows, EDGES)), noisy(ent), noisy(ext)).collect())
    assert got == [(2, "to"), (2, "to"), (3, "to"), (5, "from"), (6, "from"), (6, "to"), (7, "from")]
    report = {(r.side, r.referred_table, r.week, r.kind): r.n_orphans for r in orphan_report(noisy(spark.createDataFrame(rows, EDGES)), noisy(ent), noisy(ext)).collect()}
    assert sum(n for k, n in report.items() if k[3] == "direct") == 7 and report["to", "entities", "2024-01-01", "direct"] == 3
    # a holds orphan references; what refers to it while it exists is inherited
    assert {k: n for k, n in report.items() if k[3] == "inherited"} == {("from", "entities", "2024-01-01", "inherited"): 3, ("from", "entities", "2024-01-08", "inherited"): 2}


def test_orphans_empty(spark):
    e, n, x = spark.createDataFrame([], EDGES), spark.createDataFrame([], ENTITIES), spark.createDataFrame([], "isgl1_key string")
    assert orphan_references(e, n, x).count() == 0 and orphan_cascade(e, n, x).count() == 0 and orphan_report(e, n, x).count() == 0


def test_cascade(spark):
    ent = spark.createDataFrame([(k, day(0), None) for k in "abcde"], ENTITIES)
    ext = spark.createDataFrame([], "isgl1_key string")
    rows = [(1, "a", "gone", "Calls", day(1)), (2, "b", "a", "Calls", day(1)), (3, "c", "b", "Calls", day(1)), (4, "a", "c", "Calls", day(1)), (5, "d", "e", "Calls", day(1))]
    got = {r.isgl1_key: (r.depth, r.kind) for r in orphan_cascade(noisy(spark.createDataFrame(rows, EDGES)), ent, ext).collect()}
    assert got == {"a": (0, "direct"), "b": (1, "inherited"), "c": (2, "inherited")}


def test_hot_key_is_salted_without_changing_the_result(spark):
    rows = spark.range(6000).select(F.col("id").alias("edge_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    hot = hot_buckets(rows, "key")
    assert 0 < len(hot) <= 1000
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    a, b = salted(rows, right, "key", "edge_id", hot)
    assert a.filter("key = 'hot'").select("_salt").distinct().count() > 8
    assert a.join(b, ["key", "_salt"]).count() == rows.join(right, "key").count()
    assert a.join(b, ["key", "_salt"], "left_anti").count() == rows.join(right, "key", "left_anti").count()


def brute_changes(rows):
    best = {}
    for no, key, h, at in rows:
        if no is None or key is None:
            continue
        h = h.strip().lower().lstrip("0") or ("0" if h.strip() else None) if h is not None else None
        k = (no, key.strip())
        rank = (at is not None, at or T0, h is not None, h or "")
        if k not in best or rank > best[k][0]:
            best[k] = (rank, h)
    nos, out = sorted({k[0] for k in best}), []
    for p, n in zip(nos, nos[1:]):
        a, b = ({k[1]: v[1] for k, v in best.items() if k[0] == x} for x in (p, n))
        out += [(n, k, "added") for k in b.keys() - a.keys()] + [(n, k, "removed") for k in a.keys() - b.keys()]
        out += [(n, k, "changed") for k in a.keys() & b.keys() if a[k] and b[k] and a[k] != b[k]]
    return sorted(out)


def test_snapshot_changes(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 4, 7]), rng.choice(["a", "b", " b", "c ", "d", "e"]), rng.choice(["0a", "0A", "a", "b1", None, ""]), day(rng.randrange(4))) for _ in range(60)]
    rows += [(None, "a", "1", day(1)), (1, None, "1", day(1)), rows[0]]
    got = sorted((r.snapshot_no, r.isgl1_key, r.change_kind) for r in snapshot_changes(noisy(spark.createDataFrame(rows, SNAPS))).collect())
    assert got == brute_changes(rows)
    assert snapshot_changes(spark.createDataFrame([], SNAPS)).count() == 0
    assert snapshot_changes(spark.createDataFrame(rows[:1], SNAPS)).count() == 0


def brute_versions(rows):
    best, out = {}, []
    for r in rows:
        if r[1] is None or r[6] is None:
            continue
        k = (r[1], r[6])
        if k not in best or (r[7], r[0]) > (best[k][7], best[k][0]):
            best[k] = r
    for key in sorted({k[0] for k in best}):
        last, run = object(), []
        for at in sorted(k[1] for k in best if k[0] == key):
            state = best[key, at][2:6]
            if state != last:
                run.append((key, *state, at))
                last = state
        out += [(*v, run[i + 1][5] if i + 1 < len(run) else None) for i, v in enumerate(run)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_state_versions(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        at = T0 + timedelta(hours=rng.randrange(400))
        rows.append((i, rng.choice(["k", "k", "k", "m", "n"]), rng.random() < 0.7, True, rng.choice([None, None, "Edit"]), rng.choice([None, 5]), at, at + timedelta(hours=rng.randrange(3))))
    rows += [(9001, None, True, True, None, 1, T0, T0), (9002, "k", True, True, None, 1, None, T0)]
    got = [tuple(r) for r in state_versions(noisy(spark.createDataFrame(rows, STATES))).collect()]
    key = lambda r: (r[0], r[5])
    assert sorted(got, key=key) == sorted(brute_versions(rows), key=key)


def test_state_versions_of_a_hot_key(spark):
    """A key with most of the rows is split by day, beside keys that are not."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        at = T0 + timedelta(minutes=rng.randrange(90_000))
        rows.append((i, "hot" if i % 5 else f"k{i % 7}", rng.random() < 0.6, True, None, None, at, at + timedelta(hours=rng.randrange(3))))
    df = spark.createDataFrame(rows, STATES)
    assert hot_buckets(df, "isgl1_key")
    key = lambda r: (r[0], r[5])
    assert sorted((tuple(r) for r in state_versions(df).collect()), key=key) == sorted(brute_versions(rows), key=key)


def test_state_versions_small(spark):
    assert state_versions(spark.createDataFrame([], STATES)).count() == 0
    one = [(1, "a", True, True, None, None, T0, T0), (1, "a", True, True, None, None, T0, T0)]
    assert [tuple(r) for r in state_versions(spark.createDataFrame(one, STATES)).collect()] == [("a", True, True, None, None, T0, None)]
    # one state over more than a word of moments is one version
    many = [(i, "a", True, False, None, None, T0 + timedelta(minutes=i), T0) for i in range(200)]
    assert state_versions(spark.createDataFrame(many, STATES)).count() == 1


def test_key_statistics(spark):
    rows = [(1, "f", "t", "Calls", day(1)), (2, "f", "t", "Calls", day(3)), (3, "g", "t", "Calls", day(2)), (4, None, "t", "Calls", day(0)), (5, "f", None, None, None), (6, "f", "t", "calls", day(1))]
    got = {(r.to_key, r.edge_type): (r.n_rows, r.n_from_keys, r.first_observed_at, r.last_observed_at) for r in key_statistics(noisy(spark.createDataFrame(rows, EDGES))).collect()}
    assert got == {("t", "Calls"): (4, 2, day(0), day(3)), (None, None): (1, 1, None, None), ("t", "calls"): (1, 1, day(1), day(1))}
    assert key_statistics(spark.createDataFrame([], EDGES)).count() == 0 and heavy_pairs(spark.createDataFrame([], EDGES)).count() == 0
    big = [(i, f"f{i}", "hot" if i % 100 == 0 else f"t{i}", "Calls", day(0)) for i in range(1000)]
    assert [tuple(r) for r in heavy_pairs(spark.createDataFrame(big, EDGES)).collect()] == [("hot", "Calls")]
