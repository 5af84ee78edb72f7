"""Problem 9: mixing sources to target shares of all tokens, by entropy balancing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.columns import pick
from edgewright.llm.splitting import text_key
from edgewright.llm.tokens import VOCABULARY, token_count
from edgewright.session import cut

#: Parts into which the texts of one source and size are ranked, so that no task ranks all of them.
PARTS = 64
#: Lower bounds in tokens of the classes of sizes that are settled one after the other.
CLASSES = (1024, 64)


def clean_source(col="source") -> F.Column:
    """Lower case, without stray blanks, `_` between the words."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s_-]+", "_")


def solve_tilts(sizes: DataFrame, goals: dict[str, tuple[float, int, float]], tolerance: float = 1e-7, most: int = 80) -> dict[str, float]:
    """The dual variable of each source: sum over its texts of n * min(cap, exp(tilt * n / mean)) = goal.

    sizes: (src, n_tokens, n), goals: src -> (goal in tokens, cap, mean size). The dual is convex and separable; each
    Newton iteration is one aggregation over all sizes, kept inside a bracket that shrinks. Only one row per source
    comes to the driver; a goal of at least cap * tokens has no finite tilt and is left to the caller. After `most` steps
    every bracket has shrunk to a point; if one has not, that is an error.
    """
    low, high = {}, {}
    tilt = {s: 0.0 for s in goals}
    for _ in range(most):
        if not goals:
            break
        rows = [F.struct(F.lit(s), F.lit(float(tilt[s])), F.lit(float(c)), F.lit(float(m))) for s, (_, c, m) in goals.items()]
        par = F.map_from_entries(F.array(*[F.struct(r.getField("col1"), r) for r in rows]))
        p = F.element_at(par, F.col("src"))
        power = F.least(p.getField("col2") * F.col("n_tokens") / p.getField("col4"), F.log(p.getField("col3")))
        rate = F.exp(power)
        free = F.when(power < F.log(p.getField("col3")), rate * F.col("n_tokens") * F.col("n_tokens") / p.getField("col4")).otherwise(0.0)
        got = {r[0]: r for r in sizes.groupBy("src").agg(F.sum(rate * F.col("n_tokens") * F.col("n")).alias("g"), F.sum(free * F.col("n")).alias("h")).collect()}
        worst = 0.0
        for s, (goal, _, _) in goals.items():
            miss, slope = got[s].g - goal, got[s].h
            worst = max(worst, abs(miss) / goal)
            if abs(miss) <= tolerance * goal:
                continue
            (high if miss > 0 else low)[s] = tilt[s]
            new = tilt[s] - miss / slope if slope > 0 else None
            a, b = low.get(s), high.get(s)
            if new is None or (a is not None and new <= a) or (b is not None and new >= b) or abs(new - tilt[s]) > 8:
                new = (a + b) / 2 if a is not None and b is not None else tilt[s] + (1.0 if miss < 0 else -1.0) * max(1.0, abs(tilt[s]))
            tilt[s] = new
        if worst <= tolerance:
            return tilt
    wide = [s for s in goals if s not in low or s not in high or high[s] - low[s] > 1e-9 * (1 + abs(high[s]))]
    if wide:
        raise RuntimeError(f"no tilt found for {wide}")
    return tilt


def _copies_by_size(sizes: DataFrame, goals: dict[str, tuple[float, int]]) -> DataFrame:
    """(src, n_tokens, rate, each, extra): every text of that size is copied `each` times, `extra` of them once more.

    Sizes are settled from large to small in classes: the dual is solved for all sizes not yet settled, the rates of the
    largest class become whole copies by systematic rounding along the sizes, and what that misses of a source's goal
    is left to the smaller sizes. So a source misses its goal by no more than a text of the smallest class.
    """
    done, spark = [], sizes.sparkSession
    left = {s: g for s, (g, _) in goals.items()}
    edges = [*CLASSES, 0]
    for at, least in enumerate(edges):
        upper = edges[at - 1] if at else 1 << 31
        rest = sizes.filter(F.col("n_tokens") < upper)
        have = {r[0]: (float(r[1]), r[2]) for r in rest.groupBy("src").agg(F.sum(F.col("n") * F.col("n_tokens")), F.sum("n")).collect()}
        caps = {s: float(goals[s][1]) for s in have}
        full = {s for s in have if left[s] >= caps[s] * have[s][0] * (1 - 1e-9)}
        none = {s for s in have if left[s] <= 0}
        tilt = solve_tilts(rest.filter(~F.col("src").isin([*full, *none])), {s: (left[s], caps[s], have[s][0] / have[s][1]) for s in have if s not in full | none})
        par = spark.createDataFrame([(s, tilt.get(s, 0.0), caps[s], have[s][0] / have[s][1], s in full, s in none) for s in have], "src string, tilt double, cap double, mean double, full boolean, none boolean")
        cells = rest.filter(F.col("n_tokens") >= least).join(F.broadcast(par), "src")  # one row per target
        free = F.exp(F.least(F.col("tilt") * F.col("n_tokens") / F.col("mean"), F.log("cap")))
        cells = cells.withColumn("rate", F.when(F.col("full"), F.col("cap")).when(F.col("none"), 0.0).otherwise(free))
        cells = cells.withColumn("each", F.floor(F.col("rate") + 1e-9)).withColumn("part_rate", F.greatest(F.col("rate") - F.col("each"), F.lit(0.0)))
        # running sum of the fractional rates along the sizes of a source, in blocks of sizes
        cells = cells.withColumn("w", F.col("part_rate") * F.col("n")).withColumn("block", F.expr("n_tokens div 64"))
        upto = Window.partitionBy("src", "block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
        blocks = cells.groupBy("src", "block").agg(F.sum("w").alias("bw"))
        before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("src", "block", F.coalesce(F.sum("bw").over(before), F.lit(0.0)).alias("start"))
        mark = F.col("start") + F.coalesce(F.sum("w").over(upto), F.lit(0.0)) + 0.5
        cells = cells.join(blocks, ["src", "block"]).withColumn("mark", mark)
        cells = cut(cells.select("src", "n_tokens", "n", "rate", "each", F.least(F.floor(F.col("mark") + F.col("w")) - F.floor("mark"), F.col("n")).alias("extra")))
        for s, used in cells.groupBy("src").agg(F.sum(F.col("n_tokens") * (F.col("n") * F.col("each") + F.col("extra")))).collect():
            left[s] -= float(used)
        done.append(cells.drop("n"))
    return reduce(DataFrame.unionByName, done)


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_hash, copy_no, source, n_tokens, rate, repeats, target_share, reached_share), a row per text drawn.

    Entropy balancing: the rates nearest to one copy of each text (in relative entropy, at most max_repeats) that give
    each source its share of the tokens are exponentially tilted in the text's size; Newton iterations solve the dual.
    Rates become copies by systematic rounding along the sizes of a source, large ones first, so a source misses its
    goal by about one small text and no text is drawn more than max_repeats times. `reached_share` is the source's share of all tokens
    drawn. total_tokens: size of the mix; by default the most that reaches all shares within max_repeats. Where a source
    cannot fill its share (no texts, or a larger total), the mix falls short there and reached_share says so.

    Sources are compared in clean spelling; documents without a source or with one that has no target are left out, as
    are null ids and null or empty texts. Repeated rows count as texts of their own. Empty tables give an empty result.
    """
    documents, targets = pick(documents, "doc_id", "text", "source"), pick(targets, "source", "target_share", "max_repeats")
    targets = targets.filter("source is not null and target_share > 0 and max_repeats > 0")
    goals_in = [(r[0], float(r[1]), int(r[2])) for r in targets.select(clean_source("source"), "target_share", "max_repeats").collect()]
    names = [s for s, _, _ in goals_in]
    rows = documents.filter("text is not null and text <> '' and doc_id is not null").select("doc_id", text_key(), clean_source().alias("src"), "text").filter(F.col("src").isin(names))
    rows = cut(rows.select("doc_id", "text_hash", "src", token_count(F.col("text"), vocabulary).alias("n_tokens")))
    sizes = cut(rows.groupBy("src", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r[0]: (float(r[1]), r[2]) for r in sizes.groupBy("src").agg(F.sum(F.col("n") * F.col("n_tokens")), F.sum("n")).collect()}
    plan = [(s, share, cap, *have[s]) for s, share, cap in goals_in if s in have]
    weight = sum(p[1] for p in plan)
    size = total_tokens or min((cap * tokens / (share / weight) for _, share, cap, tokens, _ in plan), default=0.0)
    goals = {s: (size * share / weight, cap) for s, share, cap, _, _ in plan}
    cells = _copies_by_size(sizes, goals)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PARTS)))
    counts = rows.groupBy("src", "n_tokens", "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("src", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("m").join(cells, ["src", "n_tokens"])
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("src", "n_tokens", "part").orderBy("doc_id", "text_hash")))
    ranked = ranked.join(cells, ["src", "n_tokens", "part"])
    more = (F.col("before") + F.col("i") <= F.col("extra")).cast("int")
    drawn = ranked.withColumn("repeats", (F.col("each") + more).cast("int")).filter("repeats > 0")
    drawn = cut(drawn.select("doc_id", "text_hash", F.col("src").alias("source"), "n_tokens", "rate", "repeats"))
    reached = {r[0]: r[1] for r in drawn.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens"))).collect()}
    total = float(sum(reached.values()) or 1)
    shares = documents.sparkSession.createDataFrame([(s, share, reached.get(s, 0) / total) for s, share, _ in goals_in], "source string, target_share double, reached_share double")
    return drawn.join(F.broadcast(shares), "source")


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, reached_share, n_texts, n_copies, n_tokens) per target, also for sources without texts."""
    mix = mix_sources(documents, targets, total_tokens, vocabulary)
    per = mix.groupBy("source").agg(F.first("reached_share").alias("reached_share"), F.count(F.lit(1)).alias("n_texts"), F.sum("repeats").alias("n_copies"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("n_tokens"))
    out = targets.select(clean_source("source").alias("source"), "target_share").join(per, "source", "left")
    return out.na.fill(0, ["n_texts", "n_copies", "n_tokens"]).na.fill(0.0, ["reached_share"])


