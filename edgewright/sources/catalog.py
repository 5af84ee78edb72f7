"""A base folder as the store: relations are Parquet tables in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgewright.operators.relations import entity_relation
from edgewright.schemas import KEYS, RELATIONS
from edgewright.sources.tables import table


class NotFound(KeyError):
    """A key without a record."""


class Store:
    """Relations under a base path; `spec` is `parquet:<path>` or a bare path (the engine before the first colon)."""

    def __init__(self, spark: SparkSession, spec: str):
        engine, _, path = spec.partition(":") if ":" in spec.split("/")[0] else ("parquet", "", spec)
        if engine != "parquet":
            raise ValueError(f"unknown engine {engine}")
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def is_connected(self) -> bool:
        fs, path = self._fs()
        return bool(fs.exists(path))

    def list_relations(self) -> list[str]:
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted({n.removesuffix(".current") for n in names if n.endswith(".current")} | {n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and not n.startswith("_")})

    def create(self, name: str) -> None:
        """An empty relation of its fixed schema; an error if it exists."""
        self.spark.createDataFrame([], RELATIONS[name]).write.mode("error").parquet(f"{self.path}/{name}.parquet")

    def _version(self, name: str) -> str | None:
        """The folder that a relation's pointer names; None before its first replacement."""
        fs, _ = self._fs()
        pointer = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.current")
        if not fs.exists(pointer):
            return None
        return self.spark.read.text(pointer.toString()).first()[0]

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.path, self._version(name) or name)

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a relation: a new version is written beside the old one, then the pointer, one small file, is switched.
        The rows may come from the relation itself; a crash leaves one version or the other; the version before the last
        is kept for those who still read it."""
        import uuid

        fs, base = self._fs()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        old, new = self._version(name), f"_{name}.v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{new}.parquet")
        out = fs.create(hadoop(f"{self.path}/{name}.current"), True)
        out.write(bytearray(new.encode()))
        out.close()
        for status in fs.listStatus(base):
            stale = status.getPath().getName().removesuffix(".parquet")
            if stale.startswith(f"_{name}.v-") and stale not in (old, new) or stale == name:
                fs.delete(status.getPath(), True)

    def put(self, name: str, rows: DataFrame, seq: str | None = None) -> None:
        """Upsert by the relation's key; nothing to do for no rows."""
        from edgewright.operators.relations import upsert

        if not rows.isEmpty():
            self.write(name, upsert(self.read(name), rows, KEYS[name], seq))

    def remove(self, name: str, keys: DataFrame) -> int:
        """Delete by the first key column; returns the number of keys asked for."""
        from edgewright.operators.relations import delete_by_keys

        self.write(name, delete_by_keys(self.read(name), keys, KEYS[name][0]))
        return keys.distinct().count()

    def backup(self, to: str) -> None:
        for name in self.list_relations():
            self.read(name).write.mode("overwrite").parquet(f"{to}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Any SQL over the relations, which are registered as views."""
        for name in self.list_relations():
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def entity(self, key: str) -> DataFrame:
        row = entity_relation(self.read("entities").filter(F.col("isgl1_key") == key))
        if row.isEmpty():
            raise NotFound(key)
        return row

    def entities_of_file(self, path: str) -> DataFrame:
        return entity_relation(self.read("entities").filter(F.col("file_path") == path))

    def cached_hash(self, path: str) -> str | None:
        row = self.read("file_hash_cache").filter(F.col("file_path") == path).select("content_hash").first()
        return row[0] if row else None


def relation_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(relation, n_rows) of the named tables."""
    out = None
    for n in names:
        part = table(spark, folder, n).agg(F.lit(n).alias("relation"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField("relation", T.StringType()), T.StructField("n_rows", T.LongType())]))
