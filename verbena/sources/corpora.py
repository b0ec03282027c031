"""Line corpora: gzip or plain text, one sentence per line."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbena.operators.joins import lookup
from verbena.session import written

DATASET_OF_PATH = r"(?:dataset=)?([^/=]+?)(?:/part-[^/]*|\.txt(?:\.gz)?)?$"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no (0-based, the true place in its file), text.

    The files are read once: a task numbers the lines of its split as it writes them to the shared
    folder, so the numbers stay true however later jobs are planned. What comes before the split
    in its file is added from a table with one row per split. No line is sorted for this,
    nor shuffled unless there are too many splits to broadcast.
    """
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    lines = spark.read.text(paths).select(
        F.url_decode(encoded).alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("text"),
    )
    lines = written(lines, "lines")
    before = (
        Window.partitionBy("path")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        lines.groupBy("path", "_block")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
        .select(
            "path",
            "_block",
            "_first",
            "_lines",
            F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"),
        )
    )
    # A gzip file is one split, so its lines share one key however many they are.
    placed = lookup(lines, written(blocks, "splits"), ["path", "_block"], ["_id"], "_lines")
    return placed.select(
        "path",
        (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"),
        "text",
    )


def read_corpus(spark: SparkSession, paths: str | list[str], role: str) -> DataFrame:
    """role, dataset, path, line_no, text; the data set is named after its file or folder."""
    return read_lines(spark, paths).select(
        F.lit(role).alias("role"),
        F.regexp_extract("path", DATASET_OF_PATH, 1).alias("dataset"),
        "path",
        "line_no",
        "text",
    )


def full_path(spark: SparkSession, path: str) -> str:
    """A path with its scheme and one slash after it, if it is one of this machine."""
    jvm = spark._jvm
    given = jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:/", system.makeQualified(given).toString())


def read_test_passes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pass_no, dataset, path, line_no, text for an ordered list of test files or folders.

    A file listed twice is read once and gives two passes. Files are known by their whole path,
    so those of one name in different folders are different tests.
    """
    numbers: dict[str, list[int]] = {}
    for pass_no, path in enumerate(paths):
        numbers.setdefault(full_path(spark, path.rstrip("/")), []).append(pass_no)
    listed = F.array(
        *[
            F.struct(F.lit(path).alias("path"), F.lit(passes).alias("passes"))
            for path, passes in numbers.items()
        ]
    )
    path = F.regexp_replace("path", "^file:/+", "file:/")
    own = F.filter(
        listed, lambda x: (path == x["path"]) | path.startswith(F.concat(x["path"], F.lit("/")))
    )
    unknown = F.raise_error(F.concat(F.lit("not a listed test: "), path)).cast("array<int>")
    passes = F.when(F.size(own) == 0, unknown).otherwise(
        F.flatten(F.transform(own, lambda x: x["passes"]))
    )
    return read_corpus(spark, list(numbers), "test").select(
        F.explode(passes).alias("pass_no"),
        "dataset",
        "path",
        "line_no",
        "text",
    )


def write_corpus(df: DataFrame, path: str, text: str = "text", dataset: str | None = None) -> None:
    """Write one text column as gzip line files, one folder per data set if it is named.

    A data set is written by all tasks that hold a part of it.
    """
    columns = [F.col(text)] if dataset is None else [F.col(text), F.col(dataset).alias("dataset")]
    writer = df.select(*columns).write.option("compression", "gzip")
    (writer if dataset is None else writer.partitionBy("dataset")).text(path)
