"""Running measures, ranks and the hot-key join against plain windows and joins."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verbena.operators import joins
from verbena.operators.joins import hot_key_join
from verbena.operators.ordering import (
    hash_rank,
    running,
    running_count,
    running_max,
    running_min,
    running_sum,
    value_chunks,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows."""
    rng = random.Random(7)
    rows = [
        ("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", i, rng.randrange(50))
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "g string, i long, v long")


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_running_equals_one_window(skewed, width):
    cut = skewed.withColumn("chunk", F.floor(F.col("i") / width))
    mine = running(
        cut,
        ["g"],
        "chunk",
        ["i"],
        {
            "n": running_count(),
            "total": running_sum(F.col("v")),
            "low": running_min(F.col("v")),
            "before": running_max(F.col("v"), before=True),
        },
    ).drop("chunk")
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.select(
        "*",
        F.count("*").over(w).alias("n"),
        F.sum("v").over(w).alias("total"),
        F.min("v").over(w).alias("low"),
        F.max("v").over(earlier).alias("before"),
    )
    assert mine.exceptAll(plain).count() == 0
    assert mine.count() == plain.count() == 3000


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_rank_equals_row_number(skewed, digits):
    hashed = skewed.withColumn("h", F.md5(F.col("i").cast("string")))
    mine = hash_rank(hashed, ["g"], "h", ["i"], "r", digits)
    plain = hashed.withColumn(
        "r", F.row_number().over(Window.partitionBy("g").orderBy("h", "i")).cast("long")
    )
    assert mine.select("g", "i", "r").exceptAll(plain.select("g", "i", "r")).count() == 0


def test_value_chunks_split_the_hot_group_in_order(spark, skewed):
    # Left to itself, adaptive execution would put so few rows into one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut = value_chunks(skewed, ["g"], ["v", "i"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut.filter("g = 'hot'").select("_chunk").distinct().count() > 1
    placed = running(cut, ["g"], "_chunk", ["v", "i"], {"r": running_count()})
    plain = skewed.withColumn(
        "r", F.row_number().over(Window.partitionBy("g").orderBy("v", "i")).cast("long")
    )
    assert placed.select("g", "i", "r").exceptAll(plain.select("g", "i", "r")).count() == 0


@pytest.mark.parametrize("hot_keys", [1, 3, 1000])
def test_hot_key_join_equals_left_join(skewed, monkeypatch, hot_keys):
    monkeypatch.setattr(joins, "HOT_KEYS", hot_keys)
    left = skewed.withColumn("g", F.when(F.col("i") % 11 != 0, F.col("g")))
    right = (
        skewed.groupBy("g").agg(F.count("*").alias("degree"), F.max("v").alias("m"))
    ).filter("g <> 'g3'")
    mine = hot_key_join(left, right, ["g"], "degree", ["i"])
    plain = left.join(right.drop("degree"), "g", "left").select("g", "i", "v", "m")
    assert mine.columns == ["g", "i", "v", "m"]
    assert mine.exceptAll(plain).count() == 0
    assert mine.count() == 3000


def test_hot_rows_do_not_meet_in_one_partition(spark, skewed, monkeypatch):
    """With broadcasts off, the passengers of a hot key are dealt out."""
    monkeypatch.setattr(joins, "HOT_KEYS", 1)
    right = skewed.groupBy("g").agg(F.count("*").alias("degree"), F.max("v").alias("m"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = hot_key_join(skewed, right, ["g"], "degree", ["i"])
        sizes = joined.filter("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8
    assert max(r["count"] for r in sizes) < 2 * 2100 / 8
