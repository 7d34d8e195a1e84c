"""Session helpers: building a local session for tests and the bench, the
shared folder, and written stages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "corpuslens") -> SparkSession:
    """Session for tests, bench and examples.  On a cluster, callers pass
    their own session and none of this is used."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CORPUSLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors
    share.  Only a local session that names none (tests) gets a scratch folder
    of its own: there the driver is the only machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/corpuslens/{kind}-{uuid.uuid4().hex}"


#: Spark's switch that drops an execution's shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within the block, executions (of DataFrames made in it, and writes) drop
    their shuffle files when they end, not when the driver collects its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, as tightly packed columns, and
    read it back: cuts lineage, survives lost executors, and later steps read
    only their columns.  The shuffle files of the write go with it.  Whoever
    names the folder empties it."""
    spark = df.sparkSession
    path = new_path(spark, "stage")
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table whose shuffle files may lie on disk at once (``passes_of``).
PASS_ROWS = 500_000
MOST_PASSES = 8


def passes_of(rows: int) -> int:
    """Into how many passes a shuffle of so many rows is cut."""
    return max(1, min(MOST_PASSES, -(-rows // PASS_ROWS)))


def stage_in_passes(spark: SparkSession, make: Callable[[Callable[[DataFrame, str], DataFrame]], DataFrame],
                    passes: int) -> DataFrame:
    """``stage`` of a job on written tables whose rows meet by a key only, one
    class of keys after the other: the shuffle files on disk at once are those
    of one class.  ``make`` is handed a function that cuts a table (by its key
    column) down to the class."""
    def cut(k: int) -> Callable[[DataFrame, str], DataFrame]:
        return lambda df, key: df if passes == 1 else df.where(_key_class(key, passes) == k)

    path = new_path(spark, "stage")
    with shuffles_dropped(spark):
        for k in range(passes):
            df = make(cut(k))
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _key_class(key: str, passes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(passes))
