"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", name: str = "spanforge") -> SparkSession:
    """A local session; a cluster brings its own configuration instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows, dealt out evenly where the scan has fewer splits than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Parts of a scan's split that is dealt out by key; rows grow many times when they are exploded, and sorts should stay in memory.
PARTS = 16


def together(df: DataFrame, key: str) -> DataFrame:
    """The rows, dealt out by a key while they are whole.

    Rows exploded from them stay where they are: joins, windows and sums by keys that
    hold this one need no further shuffle, however many rows there are by then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, PARTS * df.rdd.getNumPartitions()), key)


def beside(spark: SparkSession) -> SparkSession:
    """A session with the same settings, but whose joins leave rows where they are if both sides lie by some of the join's keys.

    The given session keeps its own settings.  What is dealt out by document and
    joined by document and place then moves once, as whole texts.  Unions count as
    dealt out anew: while a query is planned again as it runs, their parts may cease to
    lie by the key, and a join of them would fail.
    """
    own = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.unionOutputPartitioning": "false"}
    if all(spark.conf.get(name, None) == value for name, value in own.items()):
        return spark
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if other.conf.isModifiable(key) and other.conf.get(key, None) != value:
            other.conf.set(key, value)
    for name, value in own.items():
        other.conf.set(name, value)
    return other


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a test folder if it is unset in local mode."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spanforge-')}")
        found = context._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def kept(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table to the shared folder and reads it again: lineage is cut, lost executors cost tasks only."""
    root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex[:12]}"
    numbers = itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(numbers):04d}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
