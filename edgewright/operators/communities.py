"""Communities: greedy modularity with refinement, label propagation, modularity, edges within and between clusters."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.operators.graph import CODED, _csr, _ranked, coded, coded_in_one_task, ends, in_one_task, indexed, key_type, neighbours, node_join, nodes_of, rows_in, same_rows, simple, sized, with_keys
from edgewright.operators.skew import hot_buckets, spread_join
from edgewright.session import cut


#: The nodes move in this many groups, by the first digit of their key's digest: more groups come nearer to moving one node at a time.
GROUPS = 8


def group_of(key: str = "key") -> Column:
    return (F.conv(F.substring(F.md5(F.col(key)), 1, 1), 16, 10).cast("int") % GROUPS).cast("int")


def _moving_kernel(resolution: float, passes: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, src, dst = _csr(rows)
        n, m = len(keys), float(len(rows))
        if "from_group" in rows:
            group = np.zeros(n, dtype=np.int64)
            group[src], group[dst] = rows["from_group"].to_numpy(), rows["to_group"].to_numpy()
        else:
            group = np.array([int(hashlib.md5(k.encode()).hexdigest()[0], 16) % GROUPS for k in keys])
        both, w = np.unique(np.concatenate([src * np.int64(n) + dst, dst * np.int64(n) + src]), return_counts=True)
        a, b = both // n, both % n
        k = np.bincount(a, weights=w, minlength=n)
        comm = np.arange(n)
        # a community is a node's id or -1 - id: shifted by n they are places in order
        mine = [np.flatnonzero(group[a] == g) for g in range(GROUPS)]
        mine = [(a[i] * np.int64(2 * n), b[i], w[i]) for i in mine]
        for _ in range(passes):
            moved = False
            for g in range(GROUPS):
                at = comm + n
                total = np.bincount(at, weights=k, minlength=2 * n)
                base, others, often = mine[g]
                pair = base + at[others]
                order = np.argsort(pair)
                pair = pair[order]
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                pair = pair[first]
                v, c = pair // (2 * n), pair % (2 * n)
                gain = 2 * m * (np.add.reduceat(often[order], first) if len(first) else np.zeros(0)) - resolution * k[v] * total[c]
                good = (c != at[v]) & (gain > 0)
                v, c, gain = v[good], c[good], gain[good]
                order = np.lexsort((c, -gain, v))
                v, c = v[order], c[order]
                best = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=bool)
                comm[v[best]] = c[best] - n
                moved |= bool(best.any())
            # refinement: a node of a larger community without an edge inside it goes its own way
            _, at, size = np.unique(comm, return_inverse=True, return_counts=True)
            inside = np.zeros(n, dtype=bool)
            inside[a[comm[a] == comm[b]]] = True
            out = np.flatnonzero((size[at] > 2) & ~inside)
            comm[out] = -1 - out
            if not moved and not len(out):
                break
        order: dict[int, int] = {}
        return pd.DataFrame({"key": keys, "community": [order.setdefault(c, len(order)) for c in comm.tolist()]})

    return run


def _moving_joins(edges: DataFrame, resolution: float, passes: int, groups: DataFrame | None = None) -> DataFrame:
    if groups is None:
        nodes = cut(_ranked(nodes_of(edges), "id", [F.asc("key")], 0).select("key", F.col("id").cast("long"), group_of().alias("g")))
        _, e = coded(edges, nodes)
    else:
        nodes, e = groups.select(F.col("id").alias("key"), "id", "g"), edges.select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"))
    m = float(e.count())
    near = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("o")), F.struct(F.col("dst").alias("id"), F.col("src").alias("o")))).alias("x"))
    near = near.groupBy(F.col("x.id").alias("id"), F.col("x.o").alias("o")).agg(F.count(F.lit(1)).alias("w"))
    near = cut(near.join(nodes.select("id", "g"), "id"))
    state = cut(near.groupBy("id").agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
    for _ in range(passes):
        moved = 0
        for g in range(GROUPS):
            totals = state.groupBy("c").agg(F.sum("k").alias("total"))
            of = state.select(F.col("id").alias("o"), "c")
            to = spread_join(near.filter(F.col("g") == g), of, "o", "id").groupBy("id", "c").agg(F.sum("w").alias("w"))
            choice = spread_join(to, totals, "c", "id").join(state.select("id", "k", F.col("c").alias("own")), "id").filter("c <> own")
            gain = F.lit(2 * m) * F.col("w") - F.lit(resolution) * F.col("k") * F.col("total")
            best = choice.withColumn("gain", gain).filter("gain > 0").groupBy("id").agg(F.min(F.struct(-F.col("gain"), F.col("c").alias("c"))).alias("b")).select("id", F.col("b.c").alias("new"))
            new = cut(state.join(best, "id", "left"))
            n = new.filter("new is not null").count()
            if n:
                moved += n
                state = new.select("id", "k", F.coalesce("new", "c").alias("c"))
        sizes = state.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
        mine = spread_join(near.select("id", "o").join(state.select("id", F.col("c").alias("c1")), "id"), state.select(F.col("id").alias("o"), F.col("c").alias("c2")), "o", "id")
        inside = mine.groupBy("id").agg(F.max((F.col("c1") == F.col("c2")).cast("int")).alias("inside"))
        alone = (F.col("size") > 2) & (F.col("inside") == 0)
        new = cut(state.join(sizes, "c").join(inside, "id").select("id", "k", F.when(alone, -1 - F.col("id")).otherwise(F.col("c")).alias("c"), alone.alias("alone")))
        n = new.filter("alone").count()
        state = new.drop("alone")
        if not moved and not n:
            break
    named = nodes.join(state, "id")
    least = named.groupBy("c").agg(F.min("key").alias("first"))
    return named.join(_ranked(least, "community", [F.asc("first")], 0), "c").select("key", F.col("community").cast("long"))


def communities(edges: DataFrame, resolution: float = 1.0, passes: int = 10, kernel: bool | str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(key, community): moves by modularity gain and refinement, numbered by least key from 0.

    In each pass the nodes of one group after the other move at once to the neighbouring community of greatest gain
    (e/m - resolution k K/(2 m^2) against 0), the least among equals; then nodes of larger communities without an edge
    inside go their own way. It ends when a pass changes nothing. The kernel for graphs of checked size and the joins
    give the same result. Of edges by ids in key order `groups` (id, g) has the groups of the keys.
    """
    e, kernel = sized(ends(edges), kernel)
    if key_type(e) == "long":
        return _moving_by_id(e, groups, resolution, passes) if kernel else _moving_joins(e, resolution, passes, groups)
    if kernel == CODED:
        nodes, e = indexed(e)
        found = _moving_by_id(e.select(F.col("src").alias("from_key"), F.col("dst").alias("to_key")), same_rows(nodes.select("id", group_of().alias("g")), nodes), resolution, passes)
        return with_keys(cut(found), nodes, "key", "key").select("key", "community")
    if kernel:
        return in_one_task(e, _moving_kernel(resolution, passes), "key string, community long")
    return _moving_joins(e, resolution, passes)


def _moving_by_id(e: DataFrame, groups: DataFrame, resolution: float, passes: int) -> DataFrame:
    """(key, community) by ids. The groups come from the keys, so ids alone do not do: each edge brings those of its ends."""
    group = lambda side: same_rows(groups.select(F.col("id").alias(f"{side}_key"), F.col("g").alias(f"{side}_group")), groups)
    rows = node_join(node_join(e, group("from"), "from_key", "to_key"), group("to"), "to_key", "from_key")
    return in_one_task(rows.select("from_key", "to_key", "from_group", "to_group"), _moving_kernel(resolution, passes), "key long, community long")


def _with_groups(pairs: DataFrame, nodes: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with what a and b, columns of nodes, say of their ends; nodes that are written are counted, and broadcast if few."""
    if not getattr(nodes, "_written", False):
        return pairs.join(a, "from_key").join(b, "to_key")
    return node_join(node_join(pairs, same_rows(a, nodes), "from_key", "to_key"), same_rows(b, nodes), "to_key", "from_key")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(modularity): directed, over distinct pairs within and degrees with parallel edges, summed per community."""
    e = ends(edges)
    m = rows_in(e)
    if m == 0:
        return edges.sparkSession.createDataFrame([(0.0,)], "modularity double")
    a = membership.select(F.col("key").alias("from_key"), F.col("community").alias("ca"))
    b = membership.select(F.col("key").alias("to_key"), F.col("community").alias("cb"))
    counted = e.groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("w"))
    counted = _with_groups(counted, membership, a, b)
    rows = F.array(
        F.struct(F.col("ca").alias("c"), F.col("w").alias("out"), F.lit(0).cast("long").alias("in"), F.lit(0).alias("inside")),
        F.struct(F.col("cb").alias("c"), F.lit(0).cast("long").alias("out"), F.col("w").alias("in"), (F.col("ca") == F.col("cb")).cast("int").alias("inside")),
    )
    per = counted.select(F.explode(rows).alias("r")).groupBy("r.c").agg(F.sum("r.out").alias("o"), F.sum("r.in").alias("i"), F.sum("r.inside").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - F.col("o") * F.col("i") / F.lit(float(m))) / F.lit(2.0 * m), F.lit(0.0)).alias("modularity"))


def _label_kernel(rounds: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, src, dst = _csr(rows)
        n = len(keys)
        both = np.unique(np.concatenate([src * np.int64(n) + dst, dst * np.int64(n) + src]))
        a, b = both // n, both % n
        label = np.arange(n)
        for _ in range(rounds):
            pair, count = np.unique(a * np.int64(n) + label[b], return_counts=True)
            node, seen = pair // n, pair % n
            order = np.lexsort((seen, -count, node))
            first = np.concatenate([[True], node[order][1:] != node[order][:-1]])
            new = label.copy()
            new[node[order][first]] = seen[order][first]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"key": keys, "label": keys[label]})

    return run


def label_clusters(edges: DataFrame, rounds: int = 10, kernel: bool | str | None = None) -> DataFrame:
    """(key, label): each node takes the most frequent label of its distinct undirected neighbours (itself included if
    it has an edge on itself), the least key among equals, in synchronous rounds."""
    pairs, kernel = sized(simple(edges), kernel)
    if kernel == CODED:
        return coded_in_one_task(pairs, _label_kernel(rounds), "key long, label long", ("key", "label"))
    if kernel:
        return in_one_task(pairs, _label_kernel(rounds), f"key {key_type(pairs)}, label {key_type(pairs)}")
    near = cut(neighbours(pairs))
    hot = hot_buckets(near, "other")
    state = near.select("key").distinct().withColumn("label", F.col("key"))
    for _ in range(rounds):
        seen = spread_join(near, state.select(F.col("key").alias("other"), "label"), "other", "key", hot).groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        best = seen.groupBy("key").agg(F.min(F.struct(-F.col("n"), F.col("label"))).alias("b")).select("key", F.col("b.label").alias("new"))
        new = cut(state.join(best, "key").select("key", "new", (F.col("new") != F.col("label")).alias("moved")))
        state = new.select("key", F.col("new").alias("label"))
        if new.filter("moved").isEmpty():
            break
    return state


def cluster_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, label, entity_count, internal_edges, external_edges) by descending size, then label; distinct pairs."""
    pairs = simple(edges)
    a = labels.select(F.col("key").alias("from_key"), F.col("label").alias("la"))
    b = labels.select(F.col("key").alias("to_key"), F.col("label").alias("lb"))
    both = _with_groups(pairs, labels, a, b)
    inside = F.col("la") == F.col("lb")
    sides = F.when(inside, F.array(F.struct(F.col("la").alias("label"), F.lit(1).alias("i"), F.lit(0).alias("e")))).otherwise(
        F.array(F.struct(F.col("la").alias("label"), F.lit(0).alias("i"), F.lit(1).alias("e")), F.struct(F.col("lb").alias("label"), F.lit(0).alias("i"), F.lit(1).alias("e")))
    )
    counts = both.select(F.explode(sides).alias("s")).groupBy("s.label").agg(F.sum("s.i").alias("internal_edges"), F.sum("s.e").alias("external_edges"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("entity_count"))
    rows = sizes.join(counts, "label", "left").na.fill(0, ["internal_edges", "external_edges"])
    return _ranked(rows, "cluster_id", [F.desc("entity_count"), F.asc("label")])


