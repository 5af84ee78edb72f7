"""Whole-graph algorithms: each as a fixpoint of DataFrame joins, and as a kernel in one task for graphs of checked size.

Both give the same result. A graph of at most KERNEL_EDGES edges goes to one task with its keys; one of at most CODED_EDGES
goes there as integers, by the same kernels; anything larger goes through the joins, however large. Ties are ordered by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.skew import hot_buckets, spread_join
from edgewright.session import cut, expect_large_rows

KERNEL_EDGES = 500_000
#: Without their keys so many edges fit one task too: the kernels take some 200 bytes an edge (estimated; measured
#: only with 1.6 million edges, where an executor with its Python took 1.6 GB at most in communities).
CODED_EDGES = 5_000_000
CODED = "coded"
#: Hashes of so many distinct edges fit the one task that looks for components (some 60 bytes an edge until what lies on no cycle is gone).
HASHED_EDGES = 15_000_000
#: Components of fewer edges than this are packed together.
BUNDLE_EDGES = 20_000
#: So many nodes, counted, are broadcast with their keys (some tens of megabytes) to replace these by integers.
BROADCAST_NODES = 500_000
#: Keys in the paths of cycles that one task writes, and those of one batch, about.
KEYS_PER_TASK, KEYS_PER_BATCH = 20_000_000, 200_000
LOOKED_AT = "from_key string, to_key string, n long"
PACKED = "n long, names array<string>, start binary, to binary"


def nodes_of(edges: DataFrame) -> DataFrame:
    """(key): both endpoints of all edges."""
    return edges.select(F.explode(F.array("from_key", "to_key")).alias("key")).distinct()


def is_small(edges: DataFrame, limit: int | None = None) -> bool:
    limit = KERNEL_EDGES if limit is None else limit
    if getattr(edges, "_written", False):
        return rows_in(edges) <= limit
    return edges.limit(limit + 1).count() <= limit


def rows_in(rows: DataFrame) -> int:
    """The number of rows; of what is written, counted once."""
    if getattr(rows, "_counted", None) is None:
        n = rows.count()
        if not getattr(rows, "_written", False):
            return n
        rows._counted = n
    return rows._counted


def ends(edges: DataFrame) -> DataFrame:
    """(from_key, to_key) of each edge; what is written needs no writing again."""
    return same_rows(edges.select("from_key", "to_key"), edges)


def same_rows(rows: DataFrame, of: DataFrame) -> DataFrame:
    """`rows`, columns of `of` row by row, with what is known of that."""
    rows._written, rows._distinct, rows._counted = (getattr(of, a, None) for a in ("_written", "_distinct", "_counted"))
    return rows


def simple(edges: DataFrame) -> DataFrame:
    """Distinct pairs; those known to be distinct as they are."""
    return ends(edges) if getattr(edges, "_distinct", False) else edges.select("from_key", "to_key").distinct()


def key_type(edges: DataFrame) -> str:
    """`long` where integers stand for the keys already."""
    return edges.schema["from_key"].dataType.simpleString().replace("bigint", "long")


def sized(edges: DataFrame, kernel: bool | str | None = None) -> tuple[DataFrame, bool | str]:
    """The edges, written once so that counting and computing do not each derive them, and whether a kernel may take them:
    True with their keys, CODED as integers only."""
    edges = edges if getattr(edges, "_written", False) else cut(edges)
    if kernel is None and key_type(edges) == "long":
        kernel = is_small(edges, CODED_EDGES)
    if kernel is None:
        kernel = is_small(edges) or (CODED if is_small(edges, CODED_EDGES) else False)
    return edges, kernel


def in_one_task(edges: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a kernel over the whole (checked) edge list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts, ignore_index=True) if parts else None
        if rows is not None and len(rows):
            yield kernel(rows)

    return edges.repartition(1).mapInPandas(run, schema)


def coded_in_one_task(edges: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, names: tuple[str, ...] = ("key",)) -> DataFrame:
    """Run a kernel over the edges with ids, in key order, for keys; of its result the columns `names` are keys again."""
    nodes, e = indexed(edges)
    found = cut(in_one_task(e.select(F.col("src").alias("from_key"), F.col("dst").alias("to_key")), kernel, schema))
    columns = found.columns
    for name in names:
        found = with_keys(found, nodes, name, columns[0])
    return found.select(columns)


def with_keys(rows: DataFrame, nodes: DataFrame, name: str, spread_by: str) -> DataFrame:
    """The ids in a column replaced by the keys they stand for."""
    return node_join(rows, nodes.select(F.col("id").alias(name), F.col("key").alias("_key")), name, spread_by).drop(name).withColumnRenamed("_key", name)


def node_join(rows: DataFrame, nodes: DataFrame, key: str, spread_by: str) -> DataFrame:
    """rows join nodes on key, nodes of counted size broadcast."""
    return rows.join(F.broadcast(nodes), key) if is_small(nodes, BROADCAST_NODES) else spread_join(rows, nodes, key, spread_by)


def coded(edges: DataFrame, nodes: DataFrame | None = None, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(nodes id, key; edges src, dst and the columns named): keys replaced by integers, written to the checkpoint folder."""
    nodes = cut(nodes_of(edges).withColumn("id", F.monotonically_increasing_id())) if nodes is None else nodes
    by_to, by_from = nodes.select(F.col("key").alias("to_key"), F.col("id").alias("dst")), nodes.select(F.col("key").alias("from_key"), F.col("id").alias("src"))
    if is_small(nodes, BROADCAST_NODES):
        return nodes, cut(edges.join(F.broadcast(by_to), "to_key").join(F.broadcast(by_from), "from_key").select("src", "dst", *columns))
    mid = spread_join(edges, by_to, "to_key", "from_key").drop("to_key")
    return nodes, cut(spread_join(mid, by_from, "from_key", "dst", hot_buckets(edges, "from_key")).select("src", "dst", *columns))


def indexed(edges: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """As coded(), with ids that are the places of the keys in their order."""
    nodes = cut(_ranked(cut(nodes_of(edges)), "id", [F.asc("key")], 0).select("key", F.col("id").cast("long")))
    return coded(edges, nodes, *columns)


def _csr(rows: pd.DataFrame):
    """(keys or ids in order, src, dst as positions)."""
    kind = "int64" if pd.api.types.is_integer_dtype(rows["from_key"]) else object
    ends = np.concatenate([rows["from_key"].to_numpy(dtype=kind), rows["to_key"].to_numpy(dtype=kind)])
    keys, codes = np.unique(ends if kind == "int64" else ends.astype(str), return_inverse=True)
    n = len(rows)
    return keys, codes[:n], codes[n:]


def _lists(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((dst, src))
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order]


# ---- strongly connected components -------------------------------------------------------------------------------


def _scc(start: list[int], to: list[int]) -> np.ndarray:
    """The number of each node's component."""
    n = len(start) - 1
    index, low, comp, at = [-1] * n, [0] * n, [-1] * n, start[:]
    stack, on, count, n_comp = [], bytearray(n), 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [root]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = 1
        while work:
            v = work[-1]
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = 1
                    work.append(w)
                elif on[w] and index[w] < low[v]:
                    low[v] = index[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    on[w] = 0
                    comp[w] = n_comp
                    if w == v:
                        break
                n_comp += 1
    return np.array(comp, dtype=np.int64)


def _scc_kernel(rows: pd.DataFrame) -> pd.DataFrame:
    keys, src, dst = _csr(rows)
    # what begins or ends nowhere is a component of its own: such nodes are not searched
    live = _live(src, dst, len(keys))
    least = np.arange(len(keys))
    if len(live):
        inner = np.unique(np.concatenate([src[live], dst[live]]))
        start, to = _lists(np.searchsorted(inner, src[live]), np.searchsorted(inner, dst[live]), len(inner))
        comp = _scc(start.tolist(), to.tolist())
        first = np.full(comp.max() + 1, len(keys))
        np.minimum.at(first, comp, inner)
        least[inner] = first[comp]
    return pd.DataFrame({"key": keys, "component": keys[least]})


def _live(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The edges left when those from nodes without an edge in, or to nodes without one out, have gone, round by round."""
    live = np.arange(len(src))
    while len(live):
        starts, ends_ = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        starts[src[live]] = ends_[dst[live]] = True
        left = live[ends_[src[live]] & starts[dst[live]]]
        if len(left) == len(live):
            break
        live = left
    return live


def _scc_joins(edges: DataFrame) -> DataFrame:
    nodes, all_edges = coded(edges)
    e = cut(all_edges.filter("src <> dst").distinct())
    left = nodes.select("id")
    done = None
    hot_src, hot_dst = hot_buckets(e, "src"), hot_buckets(e, "dst")
    inner = lambda e, keep: spread_join(spread_join(e, keep.select(F.col("id").alias("src")), "src", "dst", hot_src, "left_semi"), keep.select(F.col("id").alias("dst")), "dst", "src", hot_dst, "left_semi")
    while True:
        # trim: a node without edges in or out, among those left, is a component of its own
        while True:
            within = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            keep = cut(left.join(within, "id", "left_semi"))
            single = left.join(keep, "id", "left_anti").select("id", F.col("id").alias("c"))
            done = cut(single if done is None else done.unionByName(single))
            smaller = cut(inner(e, keep))
            same = smaller.count() == e.count()
            left, e = keep, smaller
            if same:
                break
        if left.isEmpty():
            break
        # colour each node with the greatest id that reaches it, then walk back from the roots within a colour
        colour = cut(left.withColumn("c", F.col("id")))
        while True:
            sent = spread_join(e, colour.withColumnRenamed("id", "src"), "src", "dst", hot_src).groupBy("dst").agg(F.max("c").alias("m"))
            new = cut(colour.join(sent.withColumnRenamed("dst", "id"), "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.col("m") > F.col("c")).alias("up")))
            moved = not new.filter("up").isEmpty()
            colour = new.select("id", "c")
            if not moved:
                break
        both = spread_join(spread_join(e, colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src", "dst", hot_src), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst", "src", hot_dst)
        inside = cut(both.filter("cs = cd").select("src", "dst"))
        members = cut(colour.filter("id = c"))
        frontier = members
        while True:
            back = spread_join(inside, frontier.select(F.col("id").alias("dst"), "c"), "dst", "src", hot_dst).select(F.col("src").alias("id"), "c").distinct()
            frontier = cut(back.join(members.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            members = cut(members.unionByName(frontier))
        done = cut(done.unionByName(members))
        left = cut(left.join(members.select("id"), "id", "left_anti"))
        e = cut(inner(e, left))
    named = nodes.join(done, "id")
    least = named.groupBy("c").agg(F.min("key").alias("component"))
    return named.join(least, "c").select("key", "component")


def components(edges: DataFrame, kernel: bool | str | None = None) -> DataFrame:
    """(key, component): strongly connected components, named by their least key; single nodes included."""
    pairs, kernel = sized(simple(edges), kernel)
    if kernel == CODED:
        return coded_in_one_task(pairs, _scc_kernel, "key long, component long", ("key", "component"))
    return in_one_task(pairs, _scc_kernel, f"key {key_type(pairs)}, component {key_type(pairs)}") if kernel else _scc_joins(pairs)


def component_sizes(parts: DataFrame) -> DataFrame:
    """(scc_id, component, size, risk) by descending size, then least key; scc_id counts from 0."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    from edgewright.functions.scalars import scc_risk

    return _ranked(sizes, "scc_id", [F.desc("size"), F.asc("component")], 0).withColumn("risk", scc_risk("size"))


def _ranked(rows: DataFrame, name: str, order: list, first: int = 1) -> DataFrame:
    """Dense position in a total order, distributed: rows are range-partitioned and numbered, partitions offset by their counts."""
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    sizes = sizes.select("_p", "_lo", F.coalesce(before, F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(sizes), "_p").withColumn(name, (F.col("_before") + F.col("_i") - F.col("_lo") + first).cast("int")).drop("_p", "_i", "_lo", "_before")


# ---- cycles ------------------------------------------------------------------------------------------------------


def _back_edges(start: list[int], to: list[int]) -> Iterator[tuple[np.ndarray, int, int]]:
    """A depth-first search in order: for each back edge the path from the root (the same array all along), the place in it
    of the edge's end, and its length."""
    n = len(start) - 1
    colour, at, place, line = bytearray(n), start[:], [0] * n, np.zeros(n + 1, dtype=np.int32)
    for root in range(n):
        if colour[root]:
            continue
        path = [root]
        colour[root], place[root], line[0] = 1, 0, root
        while path:
            v = path[-1]
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not colour[w]:
                    colour[w], place[w], line[len(path)] = 1, len(path), w
                    path.append(w)
                elif colour[w] == 1:
                    yield line, place[w], len(path)
            else:
                colour[v] = 2
                path.pop()


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A component as one row: its keys in order, its edges as places of these, and the keys in the paths of all its cycles."""
    keys, src, dst = _csr(rows)
    return _packed_row(keys.astype(object), src, dst)


def _packed_row(names: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
    start, to = _lists(src, dst, len(names))
    start, to = start.astype(np.int32), to.astype(np.int32)
    n = sum(m - i + 1 for _, i, m in _back_edges(start.tolist(), to.tolist()))
    return pd.DataFrame({"n": [n], "names": [names], "start": [start.tobytes()], "to": [to.tobytes()]})


def _packed_hashes(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """As _packed(), of edges (src, dst) between the hashes of nodes (id, key). No edge joins two components, so the search of
    several at once gives the cycles of each."""
    names = nodes["key"].tolist()
    order = np.array(sorted(range(len(names)), key=names.__getitem__), dtype=np.int64)
    ids = nodes["id"].to_numpy()[order]
    by = np.argsort(ids)
    src, dst = (by[np.searchsorted(ids, edges[c].to_numpy(), sorter=by)] for c in ("src", "dst"))
    return _packed_row(np.array(names, dtype=object)[order], src, dst)


def _cycle_batches(names: pa.Array, start: np.ndarray, to: np.ndarray, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The cycles of a component: of each `parts` batches the part-th. Each part repeats the search and writes its own."""

    def batch() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, loops)], dtype=np.int32)
        paths = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(loops))))
        return pa.RecordBatch.from_arrays([pa.array(np.diff(ends) - 1), paths], ["length", "path"])

    loops, held, nr = [], 0, 0
    for line, i, m in _back_edges(start.tolist(), to.tolist()):
        if nr % parts == part:
            loops.append(np.append(line[i:m], line[i]))
        held += m - i + 1
        if held >= KEYS_PER_BATCH:
            if loops:
                yield batch()
            loops, held, nr = [], 0, nr + 1
    if loops:
        yield batch()


def _looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """inspected() of the batches of one task."""
    places: dict[str, int] = {}
    steps, firsts, odd = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for batch in batches:
        paths, length = batch.column("path"), batch.column("length").to_numpy(zero_copy_only=False)
        flat, size = paths.flatten().dictionary_encode(), np.diff(paths.offsets.to_numpy())
        codes = np.array([places.setdefault(k, len(places)) for k in flat.dictionary.to_pylist()], dtype=np.int64)[flat.indices.to_numpy()]
        last = np.cumsum(size) - 1
        first = last - size + 1
        inner = np.ones(len(codes), dtype=bool)
        inner[last] = False
        i = np.flatnonzero(inner)
        distinct = np.bincount(np.unique((np.repeat(np.arange(len(size)), size - 1) << 32) + codes[i]) >> 32, minlength=len(size))
        odd += int(((distinct != size - 1) | (codes[first] != codes[last]) | (length != size - 1)).sum())
        steps, firsts = np.union1d(steps, (codes[i] << 32) + codes[i + 1]), np.union1d(firsts, codes[first])
    names = pa.array(list(places), pa.string())
    yield pa.RecordBatch.from_arrays([names.take(pa.array(firsts)), pa.nulls(len(firsts), pa.string()), pa.array(np.ones(len(firsts), dtype=np.int64))], ["from_key", "to_key", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([odd], pa.int64())], ["from_key", "to_key", "n"])
    for at in range(0, len(steps), KEYS_PER_BATCH):
        s = steps[at : at + KEYS_PER_BATCH]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(s >> 32)), names.take(pa.array(s & 0xFFFFFFFF)), pa.array(np.ones(len(s), dtype=np.int64))], ["from_key", "to_key", "n"])


def inspected(inside: DataFrame, most_edges: int = KERNEL_EDGES) -> DataFrame:
    """(from_key, to_key, n) of all that cycles_inside() gives: every step once, every first key (without to_key), and under two
    nulls the number of paths that pass a key twice or do not close.

    The paths hold many times the keys of the graph, so they are looked at batch by batch where they arise, and not written.
    """
    found = cycles_inside(inside, most_edges, _looked_at)
    return cut(found.groupBy("from_key", "to_key").agg(F.sum("n").alias("n")))


def _cycles_of(inside: DataFrame, look: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(length, path): the cycles of components, edges (from_key, to_key, component), that fit one task each."""
    return _written_out(inside.groupBy("component").applyInPandas(_packed, PACKED), look)


def _written_out(packed: DataFrame, look: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(length, path): the cycles of packed components. Their paths may hold far more keys than these have edges: as many tasks as
    that asks for share the writing. Components of counted size are broadcast to the tasks that share them, not moved to each."""
    spark = packed.sparkSession
    packed = cut(packed.withColumn("nr", F.monotonically_increasing_id()).withColumn("nodes", F.size("names")))
    sizes = packed.filter(F.col("n") > KEYS_PER_TASK).select("nr", "n", "nodes").collect()  # each of millions of keys
    total = packed.agg(F.sum("n")).first()[0] or 0
    expect_large_rows(spark)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // KEYS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = {c: rows.column(c)[i] for c in rows.schema.names}
                start, to = (np.frombuffer(row[c].as_py(), dtype=np.int32) for c in ("start", "to"))
                yield from _cycle_batches(row["names"].values, start, to, row["part"].as_py(), row["parts"].as_py())

    def cycles_in(rows: DataFrame) -> DataFrame:
        rows = rows.select("names", "start", "to", "part", "parts")
        return rows.mapInArrow(run, "length int, path array<string>") if look is None else rows.mapInArrow(lambda batches: look(run(batches)), LOOKED_AT)

    whole = cycles_in(packed.filter(F.col("n") <= KEYS_PER_TASK).withColumns({"part": F.lit(0), "parts": F.lit(1)}).repartition(spark.sparkContext.defaultParallelism))
    if not sizes:
        return whole
    parts = [(r["nr"], i, n) for r in sizes for n in [-(-r["n"] // KEYS_PER_TASK)] for i in range(n)]
    shares = spark.createDataFrame(parts, "nr long, part int, parts int").coalesce(1).repartition(tasks)
    large = packed.join(F.broadcast(spark.createDataFrame([(r["nr"],) for r in sizes], "nr long")), "nr", "left_semi")
    if sum(r["nodes"] for r in sizes) <= BROADCAST_NODES:
        return whole.unionByName(cycles_in(shares.join(F.broadcast(large), "nr")))
    return whole.unionByName(cycles_in(large.join(F.broadcast(shares), "nr").repartition(tasks)))


def _inner_edges(rows: pd.DataFrame) -> pd.DataFrame:
    """(from_key, to_key, component): the edges inside a component or on themselves."""
    # what begins or ends nowhere lies on no cycle: such edges go first, round by round
    keys, src, dst = _csr(rows)
    rows = rows.iloc[_live(src, dst, len(keys))]
    part = _scc_kernel(rows).set_index("key")["component"] if len(rows) else pd.Series(dtype=object)
    rows = rows.assign(component=part.reindex(rows["from_key"]).to_numpy())
    return rows[rows["component"].to_numpy() == part.reindex(rows["to_key"]).to_numpy()][["from_key", "to_key", "component"]]


def _paths(inside: DataFrame, back: bool) -> DataFrame:
    """(node, parent, path): breadth first from each component's least key, or back to it, the least parent among equals."""
    a, b = ("to_key", "from_key") if back else ("from_key", "to_key")
    steps = inside.select(F.col(a).alias("at"), F.col(b).alias("next"))
    level = cut(inside.select(F.col("component").alias("node")).distinct().select("node", F.lit(None).cast("string").alias("parent"), F.array("node").alias("path")))
    seen = level
    while True:
        way = F.concat(F.array("next"), F.col("path")) if back else F.concat("path", F.array("next"))
        far = steps.join(level.select(F.col("node").alias("at"), "path"), "at").join(seen.select(F.col("node").alias("next")), "next", "left_anti")
        best = far.groupBy("next").agg(F.min_by(F.struct("at", way.alias("path")), "at").alias("m"))
        level = cut(best.select(F.col("next").alias("node"), F.col("m.at").alias("parent"), "m.path"))
        if level.isEmpty():
            return seen
        seen = cut(seen.unionByName(level))


def _cycle_joins(inside: DataFrame) -> DataFrame:
    """(length, path): for each edge outside the breadth-first tree from the component's least key a simple cycle through
    it, by way of the tree and a tree back; equal cycles once, from their least key."""
    ahead, home = _paths(inside, False), _paths(inside, True)
    tree = ahead.filter("parent is not null").select(F.col("parent").alias("from_key"), F.col("node").alias("to_key"))
    rest = inside.select("from_key", "to_key").join(tree, ["from_key", "to_key"], "left_anti")
    rows = rest.join(ahead.select(F.col("node").alias("from_key"), F.col("path").alias("f")), "from_key").join(home.select(F.col("node").alias("to_key"), F.col("path").alias("b")), "to_key")
    rows = rows.withColumn("x", F.array_intersect("b", "f")[0])  # the first key of the way back that the way ahead has too
    i, j = F.array_position("b", F.col("x")).cast("int"), F.array_position("f", F.col("x")).cast("int")
    rows = rows.select(F.concat(F.slice("b", F.lit(1), i), F.slice("f", j + 1, F.size("f") - j)).alias("p"))
    k = F.array_position("p", F.array_min("p")).cast("int")
    rows = rows.select(F.concat(F.slice("p", k, F.size("p") - k + 1), F.slice("p", F.lit(1), k - 1), F.array(F.array_min("p"))).alias("path")).distinct()
    return rows.select((F.size("path") - 1).alias("length"), "path")


def inner_edges(pairs: DataFrame, kernel: bool | str | None = None) -> DataFrame:
    """(from_key, to_key, component): those of distinct pairs that are inside a component or on themselves, which alone can lie on
    a cycle; every component with a cycle has some."""
    pairs, kernel = sized(pairs, kernel)
    if kernel == CODED:
        nodes, e = indexed(pairs)
        inside = cut(in_one_task(e.select(F.col("src").alias("from_key"), F.col("dst").alias("to_key")), _inner_edges, "from_key long, to_key long, component long"))
        for name, spread_by in (("from_key", "to_key"), ("to_key", "from_key"), ("component", "from_key")):
            inside = with_keys(inside, nodes, name, spread_by)
    elif kernel:
        inside = in_one_task(pairs, _inner_edges, "from_key string, to_key string, component string")
    else:
        part = components(pairs, False)
        a = part.select(F.col("key").alias("from_key"), F.col("component").alias("ca"))
        b = part.select(F.col("key").alias("to_key"), F.col("component").alias("cb"))
        inside = pairs.join(a, "from_key").join(b, "to_key").filter("ca = cb").select("from_key", "to_key", F.col("ca").alias("component"))
    return cut(inside.select("from_key", "to_key", "component"))


def _hash(key: str) -> Column:
    return F.xxhash64(key)


def _pairs_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst) as bytes, at most so many in a row that it stays below some ten megabytes."""
    columns = ["n", "src", "dst"]
    held, n = [], 0

    def row() -> pa.RecordBatch:
        ends_ = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64).tobytes() for c in columns[1:]]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x], pa.binary()) for x in ends_)], columns)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 500_000:
            yield row()
            held, n = [], 0
    if n:
        yield row()


def _inner_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst, bundle, size): of all edges, packed as above, those inside a component or on themselves, the number of edges of that,
    and a number that a component has alone or shares with other small ones."""
    parts = [[np.frombuffer(x, dtype=np.int64) for x in b.column(c).to_pylist()] for b in batches for c in ("src", "dst")]
    ends_ = [np.concatenate([x for p in parts[i::2] for x in p]) if parts else np.zeros(0, dtype=np.int64) for i in (0, 1)]
    del parts
    ids = np.union1d(np.unique(ends_[0]), np.unique(ends_[1]))
    for i in (0, 1):
        ends_[i] = np.searchsorted(ids, ends_[i]).astype(np.int32)
    live = _live(*ends_, len(ids))
    if not len(live):
        return
    src, dst = (x[live] for x in ends_)
    inner, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = codes[: len(live)], codes[len(live) :]
    start, to = _lists(a, b, len(inner))
    comp = _scc(start.tolist(), to.tolist())
    inside = comp[a] == comp[b]
    src, dst, comp = ids[src[inside]], ids[dst[inside]], comp[a[inside]]
    size = np.bincount(comp)
    small = np.where(size < BUNDLE_EDGES, size, 0)
    bundle = np.where(size < BUNDLE_EDGES, np.cumsum(small) // BUNDLE_EDGES, len(src) // BUNDLE_EDGES + 1 + np.arange(len(size)))
    for at in range(0, len(src), KEYS_PER_BATCH):
        c = comp[at : at + KEYS_PER_BATCH]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (src[at : at + KEYS_PER_BATCH], dst[at : at + KEYS_PER_BATCH], bundle[c], size[c])], ["src", "dst", "bundle", "size"])


def _packed_by_hashes(edges: DataFrame, most_edges: int) -> DataFrame | None:
    """The components of edges (from_key, to_key; repeated ones too) packed, by way of hashes: keys are read where they stand, only those
    on cycles are moved. None where it cannot be told so: two keys of one hash, one of them on a cycle of the graph of hashes, more than
    HASHED_EDGES, or a component of more than most_edges.

    Equal hashes elsewhere do no harm: taking nodes for one adds walks through them only, and no cycle goes through those.
    """
    ids = edges.select(_hash("from_key").alias("src"), _hash("to_key").alias("dst")).distinct()
    rows = cut(ids.mapInArrow(_pairs_packed, "n long, src binary, dst binary"))
    if (rows.agg(F.sum("n")).first()[0] or 0) > HASHED_EDGES:
        return None
    inside = cut(rows.repartition(1).mapInArrow(_inner_hashes, "src long, dst long, bundle long, size long"))
    if (inside.agg(F.max("size")).first()[0] or 0) > most_edges:
        return None
    nodes = cut(inside.select(F.col("src").alias("id"), "bundle").distinct())  # each has an edge to another inside
    few = is_small(nodes, BROADCAST_NODES)
    near = F.broadcast if few else (lambda rows: rows)
    named = cut(edges.select(F.col("from_key").alias("key"), _hash("from_key").alias("id")).join(near(nodes), "id").distinct())
    if rows_in(named) > rows_in(nodes):
        return None
    # a key that is looked for has the hash of one of these and is another
    to = edges.select(F.col("to_key"), _hash("to_key").alias("id"))
    if not to.join(near(named), "id").filter("to_key <> key").isEmpty():
        return None
    return inside.groupBy("bundle").cogroup(named.groupBy("bundle")).applyInPandas(_packed_hashes, PACKED)


def cycles(edges: DataFrame, most_edges: int | None = None, kernel: bool | str | None = None) -> DataFrame:
    """(length, path): one cycle per back edge of a depth-first search in key order; the path repeats its first key.

    Only edges inside a component or on themselves can lie on a cycle: the search runs per component. Which cycles are
    found depends on the order of visiting, so this is sequential by nature. A component of more than `most_edges`
    edges (by default CODED_EDGES; KERNEL_EDGES where the graph has more than HASHED_EDGES) is searched by joins, which give
    other cycles: one through each edge outside a breadth-first tree, so that every cycle of the component has an edge on one of them.
    """
    if kernel is None and key_type(edges) == "string":
        packed = _packed_by_hashes(edges, CODED_EDGES if most_edges is None else most_edges)
        if packed is not None:
            return _written_out(packed)
    return cycles_inside(inner_edges(edges.select("from_key", "to_key").distinct(), kernel), KERNEL_EDGES if most_edges is None else most_edges)


def cycles_inside(inside: DataFrame, most_edges: int = KERNEL_EDGES, look: Callable | None = None) -> DataFrame:
    """As cycles(), of the edges that inner_edges() gives; with `look` what that makes of the batches of cycles."""
    huge = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_edges).select("component")
    if huge.isEmpty():
        return _cycles_of(inside, look)
    far = _cycle_joins(cut(inside.join(huge, "component", "left_semi")))
    return _cycles_of(inside.join(huge, "component", "left_anti"), look).unionByName(far if look is None else far.mapInArrow(look, LOOKED_AT))


# ---- PageRank ----------------------------------------------------------------------------------------------------


def _pagerank_kernel(damping: float, tolerance: float, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, src, dst = _csr(rows)
        n = len(keys)
        out = np.bincount(src, minlength=n).astype(float)
        rank, dangling = np.full(n, 1.0 / n), out == 0
        for _ in range(most):
            share = np.divide(rank, out, out=np.zeros(n), where=~dangling)
            new = (1 - damping) / n + damping * (np.bincount(dst, weights=share[src], minlength=n) + rank[dangling].sum() / n)
            moved = np.abs(new - rank).sum()
            rank = new
            if moved < tolerance:
                break
        return pd.DataFrame({"key": keys, "score": rank})

    return run


def _pagerank_joins(edges: DataFrame, damping: float, tolerance: float, most: int) -> DataFrame:
    nodes, e = coded(edges)
    n = nodes.count()
    e = cut(e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    hot = hot_buckets(e, "src")
    state = cut(nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").withColumn("rank", F.lit(1.0 / n)))
    for _ in range(most):
        dangling = state.filter("out is null").agg(F.sum("rank")).first()[0] or 0.0
        sent = spread_join(e, state.select(F.col("id").alias("src"), "out", "rank"), "src", "dst", hot).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w") / F.col("out")).alias("got"))
        new = state.join(sent.withColumnRenamed("dst", "id"), "id", "left").withColumn("new", F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("got", F.lit(0.0)))
        new = cut(new.select("id", "out", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("moved")))
        moved = new.agg(F.sum("moved")).first()[0]
        state = new.drop("moved")
        if moved < tolerance:
            break
    return nodes.join(state, "id").select("key", F.col("rank").alias("score"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100, kernel: bool | str | None = None) -> DataFrame:
    """(key, score): parallel edges weigh as often as they stand; the mass of nodes without an edge out is spread evenly."""
    e, kernel = sized(ends(edges), kernel)
    if kernel == CODED:
        return coded_in_one_task(e, _pagerank_kernel(damping, tolerance, most), "key long, score double")
    if kernel:
        return in_one_task(e, _pagerank_kernel(damping, tolerance, most), f"key {key_type(e)}, score double")
    return _pagerank_joins(e, damping, tolerance, most)


# ---- betweenness -------------------------------------------------------------------------------------------------


def _brandes(start: np.ndarray, to: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Sum of dependencies over the sources, breadth first by whole levels; a source costs what it reaches, not the graph."""
    n = len(start) - 1
    total, sigma, delta = np.zeros(n), np.zeros(n), np.zeros(n)
    seen, slot, degree = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.diff(start)
    for s in sources.tolist():
        level, levels, steps = np.array([s]), [np.array([s])], []
        sigma[s], seen[s] = 1.0, True
        while len(level):
            reps = degree[level]
            ends = np.cumsum(reps)
            b = to[np.arange(ends[-1]) + np.repeat(start[level] - (ends - reps), reps)]
            tree = np.flatnonzero(~seen[b])
            b, a = b[tree], np.repeat(np.arange(len(level)), reps)[tree]
            # each new node once, without sorting: the last edge to it stands for it
            slot[b] = np.arange(len(b))
            new = b[slot[b] == np.arange(len(b))]
            slot[new] = np.arange(len(new))
            sigma[new] = np.bincount(slot[b], weights=sigma[level[a]], minlength=len(new))
            seen[new] = True
            steps.append((level, a, b))
            level = new
            levels.append(new)
        for level, a, b in reversed(steps):
            delta[level] = np.bincount(a, weights=sigma[level[a]] / sigma[b] * (1 + delta[b]), minlength=len(level))
        delta[s] = 0
        reached = np.concatenate(levels)
        total[reached] += delta[reached]
        seen[reached], delta[reached] = False, 0
    return total


def _packed_lists(rows: pd.DataFrame) -> pd.DataFrame:
    """The whole graph as one row: neighbours of ids 0.. one after the other, parallel edges as often as they stand."""
    src, dst = rows["src"].to_numpy(), rows["dst"].to_numpy()
    start, to = _lists(src, dst, int(max(src.max(), dst.max())) + 1)
    return pd.DataFrame({"start": [start.astype(np.int32).tobytes()], "to": [to.astype(np.int32).tobytes()]})


def _betweenness_kernels(edges: DataFrame) -> DataFrame:
    nodes, e = indexed(edges)
    spark = edges.sparkSession
    packed = in_one_task(e, _packed_lists, "start binary, to binary").first()  # at most CODED_EDGES: 4 bytes an edge and a node
    if packed is None:
        return nodes.select("key", F.lit(0.0).alias("score"))
    graph = spark.sparkContext.broadcast((bytes(packed[0]), bytes(packed[1])))
    tasks = spark.sparkContext.defaultParallelism * 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, to = (np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in graph.value)
        sources = np.flatnonzero(np.diff(start) > 0)
        for batch in batches:
            for part in batch["id"]:
                total = _brandes(start, to, sources[part::tasks])
                hit = np.flatnonzero(total)
                yield pd.DataFrame({"id": hit, "score": total[hit]})

    sums = spark.range(0, tasks, 1, tasks).mapInPandas(run, "id long, score double").groupBy("id").agg(F.sum("score").alias("score"))
    return nodes.join(sums, "id", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))


def _betweenness_joins(edges: DataFrame, batch: int, given: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Brandes by joins, for `batch` sources at a time. given: nodes, coded edges and the sources to start from, if known."""
    nodes, e = given[:2] if given else coded(edges)
    e = cut(e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    starts = given[2] if given else e.select(F.col("src").alias("s")).distinct()
    sources = cut(_ranked(starts, "nr", [F.asc("s")], 0))
    total = None
    for b in range(-(-sources.count() // batch)):
        level = cut(sources.filter(f"nr div {batch} = {b}").select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")))
        seen, tree = level.select("s", "v"), []
        while True:
            step = level.join(e, level.v == e.src).select("s", "v", "sigma", F.col("dst").alias("t"), "w")
            step = cut(step.join(seen.withColumnRenamed("v", "t"), ["s", "t"], "left_anti"))
            if step.isEmpty():
                break
            level = cut(step.groupBy("s", "t").agg(F.sum(F.col("sigma") * F.col("w")).alias("sigma")).withColumnRenamed("t", "v"))
            tree.append((step, level))
            seen = cut(seen.unionByName(level.select("s", "v")))
        delta = None
        for step, below in reversed(tree):
            d = below.select("s", F.col("v").alias("t"), F.col("sigma").alias("sigma_t"))
            if delta is not None:
                d = d.join(delta.select("s", F.col("v").alias("t"), "delta"), ["s", "t"], "left")
            else:
                d = d.withColumn("delta", F.lit(0.0))
            delta = cut(step.join(d, ["s", "t"]).groupBy("s", "v").agg(F.sum(F.col("sigma") * F.col("w") / F.col("sigma_t") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("delta")))
            part = delta.filter("s <> v").groupBy("v").agg(F.sum("delta").alias("score"))
            total = cut(part if total is None else total.unionByName(part).groupBy("v").agg(F.sum("score").alias("score")))
    if total is None:
        return nodes.select("key", F.lit(0.0).alias("score"))
    return nodes.join(total.withColumnRenamed("v", "id"), "id", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))


def betweenness(edges: DataFrame, kernel: bool | str | None = None, batch: int = 1000) -> DataFrame:
    """(key, score): directed, not normalised, all sources; parallel edges are parallel shortest paths.

    A graph of checked size is sent to all tasks, each of which takes its share of the sources.
    """
    e, kernel = sized(ends(edges), kernel)
    return _betweenness_kernels(e) if kernel else _betweenness_joins(e, batch)


def betweenness_estimate(edges: DataFrame, pivots: int, confidence: float = 0.95, batch: int = 1000) -> DataFrame:
    """(key, score, error): betweenness from `pivots` sources alone, for graphs too large for all of them; a sampling operator.

    The sources are those whose hash comes first, a sample without bias; each stands for n / pivots of them. With the given
    probability no score is further off than `error`, by Hoeffding's bound over n nodes (a dependency is at most n - 2).
    As many pivots as there are sources give the exact scores, with error 0.
    """
    e = cut(edges.select("from_key", "to_key"))
    nodes, coded_edges = coded(e)
    n, m = nodes.count(), coded_edges.select("src").distinct().count()
    k = min(pivots, m)
    chosen = coded_edges.select(F.col("src").alias("s")).distinct().join(nodes.select(F.col("id").alias("s"), "key"), "s").orderBy(F.xxhash64("key"), "key").limit(k).select("s")
    scores = _betweenness_joins(e, batch, (nodes, coded_edges, cut(chosen)))
    error = 0.0 if k == m else m * max(n - 2, 0) * (np.log(2 * max(n, 1) / (1 - confidence)) / (2 * max(k, 1))) ** 0.5
    return scores.select("key", (F.col("score") * F.lit(m / max(k, 1))).alias("score"), F.lit(float(error)).alias("error"))


def ranked_scores(scores: DataFrame, top: int | None = None) -> DataFrame:
    """(rank, key, score) by descending score, then key; all or the first `top`."""
    if top is not None:
        scores = scores.orderBy(F.desc("score"), "key").limit(top)
    return _ranked(scores, "rank", [F.desc("score"), F.asc("key")])


# ---- k-core ------------------------------------------------------------------------------------------------------


def neighbours(edges: DataFrame) -> DataFrame:
    """(key, other): the undirected graph, each neighbour once; an edge on itself makes a node its own neighbour."""
    both = F.array(F.struct(F.col("from_key").alias("key"), F.col("to_key").alias("other")), F.struct(F.col("to_key").alias("key"), F.col("from_key").alias("other")))
    return edges.select(F.explode(both).alias("x")).select("x.key", "x.other").distinct()


def _kcore_kernel(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of fewer than k neighbours among those left go, round by round, for each k: their coreness is k - 1, the
    fixpoint of coreness(). A node with an own edge is a neighbour of its own while it is left."""
    keys, src, dst = _csr(rows)
    n = len(keys)
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    both = np.unique(a * np.int64(n) + b)
    a, to = both // n, both % n
    degree = np.bincount(a, minlength=n)
    start, size = np.concatenate([[0], np.cumsum(degree)]), degree.copy()
    core, alive, left = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), np.arange(n)
    k = 1
    while len(left):
        gone = left[degree[left] < k]
        while len(gone):
            core[gone], alive[gone] = k - 1, False
            reps = size[gone]
            ends_ = np.cumsum(reps)
            near = to[np.arange(ends_[-1]) + np.repeat(start[gone] - (ends_ - reps), reps)]
            near, lost = np.unique(near[alive[near]], return_counts=True)
            degree[near] -= lost
            gone = near[degree[near] < k]
        left = left[alive[left]]
        k = max(k + 1, int(degree[left].min()) + 1) if len(left) else k
    return pd.DataFrame({"key": keys, "coreness": core})


def _kcore_joins(edges: DataFrame) -> DataFrame:
    near = cut(neighbours(edges))
    hot = hot_buckets(near, "other")
    core = cut(near.groupBy("key").agg(F.count(F.lit(1)).alias("core")))
    while True:
        seen = spread_join(near, core.select(F.col("key").alias("other"), F.col("core").alias("est")), "other", "key", hot).groupBy("key", "est").agg(F.count(F.lit(1)).alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("est")))
        h = seen.select("key", F.least("est", at_least).alias("h")).groupBy("key").agg(F.max("h").alias("h"))
        new = cut(core.join(h, "key").select("key", F.least("core", "h").alias("new"), "core"))
        moved = not new.filter("new < core").isEmpty()
        core = new.select("key", F.col("new").alias("core"))
        if not moved:
            return core.withColumnRenamed("core", "coreness")


def coreness(edges: DataFrame, kernel: bool | str | None = None) -> DataFrame:
    """(key, coreness): undirected, by the fixpoint in which a node's value is the h-index of its neighbours' values."""
    pairs, kernel = sized(simple(edges), kernel)
    if kernel == CODED:
        return coded_in_one_task(pairs, _kcore_kernel, "key long, coreness long")
    return in_one_task(pairs, _kcore_kernel, f"key {key_type(pairs)}, coreness long") if kernel else _kcore_joins(pairs)
