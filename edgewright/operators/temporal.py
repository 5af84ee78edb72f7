"""Temporal state of entities: change sets, conflicts, promotion and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.functions.scalars import effective_code, temporal_state_valid
from edgewright.operators.relations import latest


def change_conflicts(changes: DataFrame) -> DataFrame:
    """(isgl1_key, n_changes): keys with more than one change in a set."""
    return changes.groupBy("isgl1_key").agg(F.count(F.lit(1)).alias("n_changes")).filter("n_changes > 1")


def resolve_conflicts(changes: DataFrame, keep: str = "latest") -> DataFrame:
    """One change per key: the `latest` or `earliest` by seq; `fail` raises if any key has several."""
    if keep == "fail":
        if not change_conflicts(changes).isEmpty():
            raise ValueError("several changes of one key")
        return changes
    if keep not in ("latest", "earliest"):
        raise NotImplementedError(f"conflict strategy {keep}")
    return latest(changes, ["isgl1_key"], F.desc("seq") if keep == "latest" else F.asc("seq"))


def apply_changes(entities: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with the changes marked, errors).

    An edit or deletion of a key that is missing and a creation of one that is current are errors (isgl1_key, action,
    error); a creation of a missing key puts in a stub. Columns needed: isgl1_key, current_code, future_code,
    current_ind, future_ind, future_action. changes: (isgl1_key, action, future_code), one per key.
    """
    c = changes.select("isgl1_key", F.col("action").alias("_action"), F.col("future_code").alias("_code"))
    both = entities.withColumn("_known", F.lit(True)).join(c, "isgl1_key", "full")
    known = F.coalesce("_known", F.lit(False))
    error = F.when(~known & F.col("_action").isin("Edit", "Delete"), "no such entity").when(known & F.col("current_ind") & (F.col("_action") == "Create"), "entity exists already")
    both = both.withColumn("_error", error)
    errors = both.filter("_error is not null").select("isgl1_key", F.col("_action").alias("action"), F.col("_error").alias("error"))
    ok = both.filter(known | F.col("_error").isNull())
    hit = F.col("_action").isNotNull() & F.col("_error").isNull()
    put = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    out = ok.withColumns({
        "future_code": put(F.when(F.col("_action") == "Delete", F.lit(None)).otherwise(F.col("_code")), "future_code"),
        "future_ind": put(F.col("_action") != "Delete", "future_ind"),
        "current_ind": put(F.col("_action") != "Create", "current_ind"),
        "future_action": put(F.col("_action"), "future_action"),
    })
    return out.select(*entities.columns), errors


def promote(entities: DataFrame) -> DataFrame:
    """The future becomes the present: deletions go, future code replaces current code, markers are cleared."""
    kept = entities.filter(~F.col("future_action").eqNullSafe("Delete"))
    return kept.withColumns({
        "current_code": effective_code("future_action", "future_code", "current_code"), "future_code": F.lit(None).cast("string"),
        "current_ind": F.lit(True), "future_ind": F.lit(True), "future_action": F.lit(None).cast("string"),
    })


#: Rules that a state must keep: name to condition. Callers may add their own.
RULES: dict[str, Callable[[], Column]] = {"state": lambda: temporal_state_valid("current_ind", "future_ind", "future_action")}


def broken_rules(rows: DataFrame, rules: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """The rows once per rule they break, with its name in `rule`; a condition that is null is broken."""
    checks = [F.when(~F.coalesce(rule(), F.lit(False)), name) for name, rule in (RULES if rules is None else rules).items()]
    broken = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    return rows.withColumn("rule", F.explode(broken))


def invalid_states(rows: DataFrame) -> DataFrame:
    """Rows whose (current_ind, future_ind, future_action) break the rules."""
    return rows.filter(~temporal_state_valid("current_ind", "future_ind", "future_action"))


def add_changes(pending: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes accepted, changes rejected): a key that is being changed already takes no second change; of several new
    ones of a key the first by seq is taken."""
    first = latest(new, ["isgl1_key"], F.asc("seq"))
    ok = first.join(pending.select("isgl1_key"), "isgl1_key", "left_anti").select(*new.columns)
    return ok, new.join(ok.select("isgl1_key", "seq"), ["isgl1_key", "seq"], "left_anti").select(*new.columns)


def changed_entities(entities: DataFrame) -> DataFrame:
    return entities.filter("future_action is not null")
