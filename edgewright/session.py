"""Session helpers: a tuned local session, the shared checkpoint folder, safe size estimates."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "edgewright", memory: str = "8g") -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only where none is set, fall back to one of our own.

    The fallback is meant for tests on one machine: a cluster must name a shared folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="edgewright-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there: lineage ends, lost executors cost nothing.

    A checkpoint keeps the optimizer's size estimate, and estimates of joins multiply: in a loop they would grow into
    numbers that take longer to multiply than the joins to run. Beyond a petabyte the estimate is forgotten; sizes are then
    known from the shuffles while the query runs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())).bit_length() > 50:
        done = DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), spark)
    done._written = True
    return done


def expect_large_rows(spark: SparkSession) -> None:
    """Rows of megabytes: by default Parquet's writer looks at its pages and row groups after a hundred to ten thousand rows, and would hold these.
    Their keys repeat: each is written once a row group if the dictionary holds them all and the first page repeats some.

    A result is written by the caller, so this is set in the session, unless the caller has set it.
    """
    for name, value in (("page.size.row.check.min", 1), ("page.size.row.check.max", 1), ("block.size.row.check.min", 1), ("block.size.row.check.max", 10), ("dictionary.page.size", 128 << 20), ("page.size", 8 << 20)):
        if spark.conf.get(f"parquet.{name}", None) is None:
            spark.conf.set(f"parquet.{name}", str(value))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_edgewright_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="edgewright-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "edgewright"), "zip", os.path.dirname(home), "edgewright"))
    sc._edgewright_shipped = True
