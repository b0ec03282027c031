"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: str | int | None = None, **settings: str) -> SparkSession:
    """A session with the settings the library is tested under.

    With ``cores`` it is a local one; without, the master is what the submitting command or
    the environment says, and local only if they say nothing.
    """
    builder = SparkSession.builder
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    elif not SparkConf().contains("spark.master"):
        builder = builder.master(os.environ.get("MASTER", "local[*]"))
    builder = (
        builder.appName("verbena")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Few bytes can be much work (arrays, hashes): keep all cores busy on small data.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # Once the sizes are known, a join whose partitions are all small needs no sort.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        # The JVM never compiles methods of more bytecode; such a stage runs operator by operator.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="verbena-"))
        named = context.getCheckpointDir()
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for one written table."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    For tables that several later steps use, such as fitted counts: each step would
    otherwise prune other columns and so read and count the corpus again. The files
    outlive lost executors, and a later read prunes columns as any scan does. What the writing
    shuffled is nobody's any more and leaves the disks at once, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over the cores when the input has fewer files than cores.

    A gzip file, like a Parquet file of one row group, is read by one task. With
    many files, the usual case at scale, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
