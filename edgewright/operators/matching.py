"""Matching new entities with known ones, and lines with the entities that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.operators.skew import spread_join

TOLERANCE = 10


def match_entities(new: DataFrame, old: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(new's columns, old_key, match): `content` for the same hash, name and file, else `position` for the same name and
    file with starts at most `tolerance` lines apart, else `new`. Among several the least key is taken.

    new needs (name, file_path, line_start, content_hash), old also (key). One equi join on name and file carries both
    rules; the band is checked inside, so no pairs beyond one name of one file arise.
    """
    n = new.withColumn("_id", F.monotonically_increasing_id())
    o = old.select("key", F.col("name"), F.col("file_path"), F.col("line_start").alias("_start"), F.col("content_hash").alias("_hash"))
    both = n.select("_id", "name", "file_path", "line_start", "content_hash").join(o, ["name", "file_path"])
    rule = F.when(F.col("content_hash") == F.col("_hash"), 1).when(F.abs(F.col("line_start") - F.col("_start")) <= tolerance, 2)
    best = both.withColumn("_rule", rule).filter("_rule is not null").groupBy("_id").agg(F.min(F.struct("_rule", "key")).alias("_best"))
    out = n.join(best, "_id", "left")
    return out.withColumns({"old_key": F.col("_best.key"), "match": F.when(F.col("_best._rule") == 1, "content").when(F.col("_best._rule") == 2, "position").otherwise("new")}).drop("_id", "_best")


def removed_entities(old: DataFrame, matched: DataFrame) -> DataFrame:
    """Old entities that no new one matches."""
    return old.join(matched.filter("old_key is not null").select(F.col("old_key").alias("key")).distinct(), "key", "left_anti")


def containing_entity(sites: DataFrame, entities: DataFrame) -> DataFrame:
    """(site_id, isgl1_key): the entity with the smallest range of lines around a site; functions and methods before
    impl blocks among equals, then the least key; null where none contains it.

    sites: (site_id, file_path, line); entities: (isgl1_key, file_path, line_start, line_end, entity_type). The join is
    on the file, so its fan-out is bounded by the entities of one file; the minimum is combined before the shuffle.
    """
    e = entities.select("isgl1_key", F.col("file_path"), "line_start", "line_end", F.when(F.col("entity_type").isin("function", "method"), 0).otherwise(1).alias("prio"))
    hits = sites.join(e, "file_path").filter("line between line_start and line_end")
    best = hits.groupBy("site_id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "prio", "isgl1_key")).alias("b"))
    return sites.select("site_id").join(best, "site_id", "left").select("site_id", F.col("b.isgl1_key").alias("isgl1_key"))


def next_function(files: DataFrame, mark: str = r"^\s*#\[(tokio::)?test\b", function: str = r"^\s*(pub(\([^)]*\))?\s+)?(async\s+)?fn\s+(\w+)") -> DataFrame:
    """(file_id, line, name): functions that directly follow a test mark; only blank lines and attributes may lie between."""
    from pyspark.sql import Window

    lines = files.select("file_id", F.posexplode(F.split("current_code", "\n")).alias("pos", "text"))
    kept = lines.filter(~F.col("text").rlike(r"^\s*$") & (F.col("text").rlike(mark) | ~F.col("text").rlike(r"^\s*#\[")))
    after = kept.withColumn("next", F.lead("text").over(Window.partitionBy("file_id").orderBy("pos"))).filter(F.col("text").rlike(mark))
    return after.select("file_id", (F.col("pos") + 1).cast("int").alias("line"), F.regexp_extract("next", function, 4).alias("name")).filter("name <> ''")


def placeholder_entities(edges: DataFrame) -> DataFrame:
    """(isgl1_key, language, entity_type, entity_name, crate_name): records for the keys outside the code base that edges
    point to: five parts, `external-dependency-<crate>` or `unresolved-reference` as path and `0-0` as lines."""
    parts = F.split("to_key", ":")
    keys = edges.select("to_key").distinct().withColumn("p", parts)
    path = F.get("p", F.lit(3))
    ok = (F.size("p") == 5) & (F.get("p", F.lit(4)) == "0-0") & ((path == "unresolved-reference") | path.rlike("^external-dependency-.+"))
    crate = F.when(path != "unresolved-reference", F.regexp_replace(path, "^external-dependency-", ""))
    kind = F.when(F.get("p", F.lit(1)) == "fn", "function").otherwise(F.get("p", F.lit(1)))
    return keys.filter(ok).select(F.col("to_key").alias("isgl1_key"), F.get("p", F.lit(0)).alias("language"), kind.alias("entity_type"), F.get("p", F.lit(2)).alias("entity_name"), crate.alias("crate_name"))


def resolve_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose unresolved target's name belongs to exactly one function or method of the language point to it instead."""
    named = entities.filter("entity_type in ('function', 'method')").select(F.get(F.split("isgl1_key", ":"), F.lit(2)).alias("name"), "language", "isgl1_key")
    single = named.groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"), F.min("isgl1_key").alias("target")).filter("n = 1").drop("n")
    p = F.split("to_key", ":")
    is_open = F.coalesce(F.get(p, F.lit(3)) == "unresolved-reference", F.lit(False))
    rest, todo = edges.filter(~is_open), edges.filter(is_open).withColumns({"language": F.get(p, F.lit(0)), "name": F.get(p, F.lit(2))})
    # names are few beside the edges that call them: they are spread by the hash of the caller
    keyed = todo.withColumn("_name", F.concat_ws(":", "language", "name"))
    found = spread_join(keyed, single.select(F.concat_ws(":", "language", "name").alias("_name"), "target"), "_name", "from_key", how="left")
    return rest.unionByName(found.withColumn("to_key", F.coalesce("target", "to_key")).select(*edges.columns))
