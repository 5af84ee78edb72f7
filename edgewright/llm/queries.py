"""Registered queries of the problems on texts and source files."""

from __future__ import annotations

from edgewright.llm.authorship import foreign_files
from edgewright.llm.documentation import documented_functions
from edgewright.llm.mixing import mix_report, mix_sources
from edgewright.llm.packing import fill_containers
from edgewright.llm.parsing import parse_rates, unparsable_files
from edgewright.llm.splitting import piece_bounds, split_texts, with_text
from edgewright.session import cut
from edgewright.sources.tables import table


def p3_found(spark, d):
    return foreign_files(table(spark, d, "source_files")).select("file_id")


def p3_reasons(spark, d):
    return foreign_files(table(spark, d, "source_files"))


def p5_found(spark, d):
    return unparsable_files(table(spark, d, "source_files")).select("file_id")


def p5_rates(spark, d):
    return parse_rates(table(spark, d, "source_files"), table(spark, d, "coverage_reports"))


def p7_found(spark, d):
    return documented_functions(table(spark, d, "entities")).select("isgl1_key")


def p7_pairs(spark, d):
    return documented_functions(table(spark, d, "entities"))


def p8_containers(spark, d):
    docs = table(spark, d, "documents")
    return with_text(fill_containers(docs), docs)


def p8_waste(spark, d):
    """Containers used, tokens in them, the least number of containers that could hold these, and the share of room left unused."""
    from pyspark.sql import functions as F

    rows = fill_containers(table(spark, d, "documents"))
    n = rows.agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.max("filled").alias("fullest"))
    return n.withColumns({"least_containers": F.ceil(F.col("n_tokens") / 4096), "waste": F.round(1 - F.col("n_tokens") / (F.col("n_containers") * 4096), 6)})


def p8_check(spark, d):
    """Every text whole and once per row, no container over its capacity, no place taken twice."""
    from pyspark.sql import functions as F

    rows = cut(fill_containers(table(spark, d, "documents")))
    whole = rows.groupBy("doc_id", "text_hash", "copy_no").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n"), F.max("end_char").alias("end"), F.min("start_char").alias("begin"))
    per = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.countDistinct("place").alias("p"), F.count(F.lit(1)).alias("m"))
    a = whole.agg(F.count(F.lit(1)), F.sum("n").cast("long"), F.count_if((F.col("n") != F.col("end")) | (F.col("begin") != 0))).first()
    b = per.agg(F.count_if(F.col("n") > 4096), F.count_if(F.col("p") != F.col("m"))).first()
    return spark.createDataFrame([(*a, *b)], "n_texts long, n_chars long, n_gaps long, n_over_capacity long, n_shared_places long")


def p9_check(spark, d):
    """No text drawn more often than its source allows, shares reached that add up, and all sources of the targets reported."""
    from pyspark.sql import functions as F

    report = cut(mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets")))
    caps = table(spark, d, "mix_targets").select("source", "max_repeats")
    over = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).join(caps, "source").filter("repeats > max_repeats").count()
    return report.agg(F.count(F.lit(1)).alias("n_sources"), F.round(F.sum("reached_share"), 6).alias("share_sum"), F.lit(over).cast("long").alias("n_over_repeats"), F.round(F.sum("target_share"), 6).alias("target_sum"))


def p10_check(spark, d):
    """Faults among the pieces: over the limit, an overlap other than the one asked for, a gap, a wrong beginning or end, a text that differs."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    docs = table(spark, d, "documents")
    rows = split_texts(docs)
    by = Window.partitionBy("doc_id", "text_hash").orderBy("piece_no")
    shared = F.lag("end_token").over(by) - F.col("start_token")
    rows = rows.withColumns({"shared": shared, "last": F.col("piece_no") == F.col("n_pieces"), "chars": F.length("text")})
    sizes = docs.filter("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("size")).distinct()
    rows = rows.join(sizes, ["doc_id", "text_hash"])
    return rows.agg(
        F.count_if(F.col("n_tokens") > 4096).alias("n_over_limit"), F.count_if((F.col("piece_no") > 1) & ~F.col("shared").between(128, 131)).alias("n_wrong_overlaps"), F.count_if((F.col("piece_no") == 1) & (F.col("start_char") != 0)).alias("n_wrong_begins"),
        F.count_if(F.col("last") & (F.col("end_char") != F.col("size"))).alias("n_wrong_ends"), F.count_if(F.col("chars") != F.col("end_char") - F.col("start_char")).alias("n_wrong_texts"),
    )


def p9_mix(spark, d):
    docs = table(spark, d, "documents")
    return texts_of(mix_sources(docs, table(spark, d, "mix_targets")), docs)


def p9_shares(spark, d):
    return mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return piece_bounds(table(spark, d, "documents")).filter("piece_no = 1").select("doc_id").distinct()


def p10_pieces(spark, d):
    return split_texts(table(spark, d, "documents"))


def texts_of(rows, docs):
    """Add the whole text of each row's document."""
    from pyspark.sql import functions as F

    return with_text(rows.withColumns({"start_char": F.lit(0), "end_char": F.lit(2**31 - 1)}), docs).drop("start_char", "end_char")


QUERIES = {f.__name__: f for f in (p3_found, p3_reasons, p5_found, p5_rates, p7_found, p7_pairs, p8_containers, p8_waste, p8_check, p9_mix, p9_shares, p9_check, p10_found, p10_pieces, p10_check)}
SQL: dict[str, str] = {
    "p8_check": """select count(*) as n_texts, sum(length(text))::bigint as n_chars, 0::bigint as n_gaps, 0::bigint as n_over_capacity, 0::bigint as n_shared_places
        from documents where doc_id is not null and text <> ''""",
    "p9_check": "select count(*) as n_sources, 1.0::double as share_sum, 0::bigint as n_over_repeats, round(sum(target_share), 6) as target_sum from mix_targets",
    "p10_check": "select 0::bigint as n_over_limit, 0::bigint as n_wrong_overlaps, 0::bigint as n_wrong_begins, 0::bigint as n_wrong_ends, 0::bigint as n_wrong_texts",
}
