"""Coverage and diagnostics of ingestion: files against parsed files, words, excluded tests, ignored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions import scalars as S

#: Extensions eligible for parsing and directories that the coverage walk leaves out.
ELIGIBLE = ("rs", "py", "js", "ts", "go", "java", "c", "h", "cpp", "hpp", "rb", "php", "cs", "swift")
EXCLUDED_DIRS = (".git", "target", "node_modules", "__pycache__", ".build", "vendor", ".idea", ".vscode")


def walked(files: DataFrame) -> DataFrame:
    """(file_path): distinct files outside the excluded directories."""
    dirs = F.split(S.folder_of("file_path"), "/")
    return files.filter("file_path is not null").select("file_path").distinct().filter(~F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in EXCLUDED_DIRS])))


def eligible(files: DataFrame) -> DataFrame:
    return walked(files).filter(S.extension_of("file_path").isin(*ELIGIBLE))


def parsed_files(entities: DataFrame) -> DataFrame:
    """(file_path): files that entities come from; placeholders are none."""
    return entities.select("file_path").distinct().filter(~F.col("file_path").startswith("unresolved") & ~F.col("file_path").startswith("external"))


def unparsed_files(files: DataFrame, entities: DataFrame) -> DataFrame:
    return eligible(files).join(parsed_files(entities), "file_path", "left_anti")


def folder_coverage(files: DataFrame, entities: DataFrame, depth: int = 2) -> DataFrame:
    """(folder_path, depth, total_files, eligible_files, parsed_files, coverage_pct) per folder at a depth."""
    hit = parsed_files(entities).withColumn("parsed", F.lit(1))
    rows = eligible(files).join(hit, "file_path", "left").withColumn("folder_path", S.folder_at_depth("file_path", depth) if depth else F.lit("."))
    out = rows.groupBy("folder_path").agg(F.count(F.lit(1)).alias("eligible_files"), F.count("parsed").alias("parsed_files"))
    return out.select("folder_path", F.lit(depth).alias("depth"), F.col("eligible_files").alias("total_files"), "eligible_files", "parsed_files", S.percent("parsed_files", "eligible_files", 0.0).alias("coverage_pct"))


def coverage_summary(files: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total, eligible and parsed files, coverage (may exceed 100), entities, edges, files left, the first 100 of them."""
    left = unparsed_files(files, entities)
    n = {
        "total_files": walked(files).count(), "eligible_files": eligible(files).count(), "parsed_files": parsed_files(entities).count(),
        "entity_count": entities.select("isgl1_key").distinct().count(), "edge_count": edges.count(), "error_count": left.count(),
    }
    shown = [r[0] for r in left.orderBy("file_path").limit(100).collect()]  # the report shows at most 100
    row = (n["total_files"], n["eligible_files"], n["parsed_files"], 100.0 * n["parsed_files"] / n["eligible_files"] if n["eligible_files"] else 0.0, n["entity_count"], n["edge_count"], n["error_count"], shown)
    return entities.sparkSession.createDataFrame([row], "total_files long, eligible_files long, parsed_files long, coverage_pct double, entity_count long, edge_count long, error_count long, unparsed_files array<string>")


def word_coverage(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Words per file: of the source, of its CODE entities, imports and comments; raw and effective coverage in percent.

    One row per file_path; a file without text has none of its words; percentages are 100 where nothing is to cover.
    """
    once = files.filter("file_path is not null").select("file_path", S.language_of_path("file_path").alias("language"), "current_code")
    text = F.coalesce("current_code", F.lit(""))
    counted = once.select("file_path", "language", S.word_count(text).alias("s"), S.import_words(text).alias("i"), S.comment_words(text, "language").alias("c")).groupBy("file_path").agg(
        F.max("language").alias("language"), F.max("s").alias("source_word_count"), F.max("i").alias("import_word_count"), F.max("c").alias("comment_word_count")
    )
    own = entities.filter("entity_class = 'CODE'").groupBy("file_path").agg(F.sum(S.word_count(F.coalesce("current_code", F.lit("")))).alias("entity_word_count"), F.count(F.lit(1)).alias("entity_count"))
    rows = counted.join(own, "file_path", "left").na.fill(0, ["entity_word_count", "entity_count"])
    effective = F.greatest(F.col("source_word_count") - F.col("import_word_count") - F.col("comment_word_count"), F.lit(0))
    return rows.select(
        S.folder_of("file_path").alias("folder_path"), S.filename_of("file_path").alias("filename"), F.coalesce("language", F.lit("unknown")).alias("language"), "source_word_count", "entity_word_count", "import_word_count", "comment_word_count",
        S.percent("entity_word_count", "source_word_count", 100.0).alias("raw_coverage_pct"), S.percent("entity_word_count", effective, 100.0).alias("effective_coverage_pct"), "entity_count",
    )


def excluded_tests(entities: DataFrame) -> DataFrame:
    """Test entities with their place, as ingestion reports them."""
    sig = F.from_json("interface_signature", "struct<name:string,line_range:struct<start:long,end:long>>")
    rows = entities.filter("entity_class = 'TEST'").withColumn("s", sig)
    return rows.select(
        F.coalesce("s.name", S.name_of_key("isgl1_key")).alias("entity_name"), S.folder_of("file_path").alias("folder_path"), S.filename_of("file_path").alias("filename"), "entity_class", "language",
        F.coalesce("s.line_range.start", F.lit(0).cast("long")).alias("line_start"), F.coalesce("s.line_range.end", F.lit(0).cast("long")).alias("line_end"), F.lit("entity_class is TEST").alias("detection_reason"),
    )


def ignored_files(files: DataFrame) -> DataFrame:
    """Files that no parser takes, with the reason."""
    rows = files.filter("file_path is not null").select("file_path").distinct().withColumn("extension", F.coalesce(S.extension_of("file_path"), F.lit("")))
    dirs = F.split(S.folder_of("file_path"), "/")
    skipped = F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in EXCLUDED_DIRS]))
    rows = rows.withColumn("reason", F.when(skipped, "excluded directory").when(~F.col("extension").isin(*ELIGIBLE), "unsupported extension"))
    return rows.filter("reason is not null").select(S.folder_of("file_path").alias("folder_path"), S.filename_of("file_path").alias("filename"), "extension", "reason")


def coverage_averages(words: DataFrame) -> DataFrame:
    return words.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.avg("raw_coverage_pct"), F.lit(0.0)).alias("avg_raw_pct"), F.coalesce(F.avg("effective_coverage_pct"), F.lit(0.0)).alias("avg_effective_pct"))


def folder_tree(entities: DataFrame) -> DataFrame:
    """(l1, l2_folders, n_entities): the folders below each top folder, in order."""
    per = entities.groupBy("root_subfolder_l1", "root_subfolder_l2").agg(F.count(F.lit(1)).alias("n"))
    named = F.collect_list(F.when(F.col("root_subfolder_l2") != "", F.col("root_subfolder_l2")))
    return per.groupBy(F.col("root_subfolder_l1").alias("l1")).agg(F.array_join(F.sort_array(named), ",").alias("l2_folders"), F.sum("n").alias("n_entities"))
