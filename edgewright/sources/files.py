"""Source trees as tables: walking, eligibility, size limits, language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.functions.scalars import folder_of, language_of_path

#: Fixed value: largest file that is read, in bytes.
MAX_SIZE = 100 * 1024 * 1024


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime): every file below root; contents are read only if asked for later."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", "modificationTime")


def nested_repositories(spark: SparkSession, root: str) -> list[str]:
    """Folders below root, at any depth, that have a .git of their own; the file source leaves such names out."""
    glob = lambda *parts: fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "/".join(parts))) or []
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, level = [], ["*"]
    while any(h.isDirectory() for h in glob(*level)):
        out += [h.getPath().getParent().toString() for h in glob(*level, ".git")]
        level.append("*")
    return out


def eligible(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, nested: list[str] | None = None) -> DataFrame:
    """Files outside nested repositories that match no exclude and, if any are given, an include pattern.

    A pattern is a substring of the path, `*` aside; nested is what nested_repositories found.
    """
    out = files
    if nested:
        repos = files.sparkSession.createDataFrame([(n,) for n in nested], "repo string")
        # each file's ancestors are looked up, so the join is on equality
        parts = F.split(folder_of("path"), "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        inside = files.select("path", F.explode(up).alias("repo")).join(repos, "repo", "left_semi").select("path").distinct()
        out = out.join(inside, "path", "left_anti")
    for p in exclude or []:
        out = out.filter(~F.col("path").contains(p.replace("*", "")))
    if include:
        hit = F.lit(False)
        for p in include:
            hit = hit | F.col("path").contains(p.replace("*", ""))
        out = out.filter(hit)
    return out


def read_texts(spark: SparkSession, root: str, max_size: int = MAX_SIZE) -> tuple[DataFrame, DataFrame]:
    """((file_path, language, current_code), errors): texts below root; files beyond max_size and other bytes than UTF-8 are errors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = files.filter(F.col("length") <= max_size)
    text = F.expr("try_validate_utf8(cast(content as string))")
    read = small.select(F.col("path").alias("file_path"), language_of_path("path").alias("language"), text.alias("current_code"))
    too_large = files.filter(F.col("length") > max_size).select(F.col("path").alias("file_path"), F.lit("TOO_LARGE").alias("tag"), F.concat(F.lit("size "), F.col("length")).alias("detail"))
    broken = read.filter("current_code is null").select("file_path", F.lit("READ_ERROR").alias("tag"), F.lit("not UTF-8").alias("detail"))
    return read.filter("current_code is not null"), too_large.unionByName(broken)
