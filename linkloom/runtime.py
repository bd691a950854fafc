"""Session-level helpers: table loading, spreading small inputs, cutting lineage.

Nothing here runs at import time and nothing changes the caller's session settings.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
_own_dirs: dict[str, str] = {}
_kept: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Let the Python workers import this package where the repository is at the same path."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int | None:
    """The number of partitions of a plan without a shuffle, known from its splits; None for one with a shuffle.

    How many partitions an adaptive plan has is known only once its shuffles have run, so it is not asked.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return None
    return execution.toRdd().getNumPartitions()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input of fewer partitions than cores, such as one small file, over the cluster.

    Large inputs have a partition for each split already and pass unchanged, without a shuffle; so do plans that
    end with a shuffle of their own.
    """
    cores, have = df.sparkSession.sparkContext.defaultParallelism, partitions(df)
    if have is None or have >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def together(df: DataFrame, key: str) -> DataFrame:
    """Rows of one key in one partition and next to each other; rows with a null key are spread by their content."""
    route = F.when(F.col(key).isNull(), F.xxhash64(*df.columns)).otherwise(F.xxhash64(key))
    return df.repartition(route).sortWithinPartitions(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local tests, where it is unset, a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="linkloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def own_dir(spark: SparkSession) -> str:
    """Where this application writes what it needs itself; dropped when it ends."""
    path = f"{shared_dir(spark)}/linkloom/{spark.sparkContext.applicationId}"
    if path not in _kept:
        _kept.add(path)
        atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder's name says whose it was
        pass


class Table:
    """A written intermediate table: survives lost executors, can be dropped once no plan needs it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema
        self.counted: int | None = None

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _drop(self.spark, self.path)


def write_table(df: DataFrame, name: str = "t", count: str | None = None) -> Table:
    """Write df into the shared folder; later plans read the written columns only.

    With `count`, a condition, the table's `counted` holds the number of rows that satisfy it, without a pass of its own.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table = Table(spark, path, df.schema)
    if count:
        seen = Observation()
        df = df.observe(seen, F.coalesce(F.sum(F.when(F.expr(count), 1).otherwise(0)), F.lit(0)).alias("n"))
    df.write.option("compression", "zstd").parquet(path)
    table.counted = seen.get["n"] if count else None
    return table


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    return write_table(df, name).df


def first_delivery(df: DataFrame, key: str, late: str = "loaded_at") -> DataFrame:
    """One row per key, the one loaded first; rows delivered again hold the same values.

    Rows with a null key cannot be told apart and are kept as they are.
    """
    if late not in df.columns:
        return df.dropDuplicates([key])
    cols = [c for c in df.columns if c != key]
    kept = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(F.col(late).isNull(), F.col(late))).alias("_r"))
    return kept.select(key, "_r.*").select(*df.columns).unionByName(df.filter(F.col(key).isNull()))
