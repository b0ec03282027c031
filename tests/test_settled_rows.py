"""Rows whose keys are all hot or missing stay where they are; the others find the same values."""

import pytest
from pyspark.sql import functions as F

from verbena.operators import joins
from verbena.operators.joins import lookups
from verbena.session import written


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(4000).select(
        "id",
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("a"), "id")).alias("a"),
        F.when(F.col("id") % 3 < 2, F.lit(7)).otherwise(F.col("id") % 50 + 100).cast("int").alias("b"),
    )
    first = rows.dropna().groupBy("a").agg(F.count("*").alias("n"), F.max("id").alias("x"))
    second = rows.groupBy("b").agg(F.count("*").alias("n"), F.min("id").alias("y")).filter("b <> 120")
    return [written(df, "table") for df in (rows, first, second)]


@pytest.mark.parametrize("hot_keys", [0, 1, 10, 10_000])
@pytest.mark.parametrize("degree", [None, "n"])
def test_lookups_equal_left_joins(tables, monkeypatch, hot_keys, degree):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_KEYS", hot_keys)
    rows, first, second = tables
    if degree is None:
        first, second = first.drop("n"), second.drop("n")
    mine = lookups(rows, [(first, ["a"], degree), (second, ["b"], degree)], ["id"])
    plain = rows.join(tables[1].drop("n"), "a", "left").join(tables[2].drop("n"), "b", "left")
    assert mine.columns == ["id", "a", "b", "x", "y"]
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.select(mine.columns).collect()))


def test_a_hot_row_is_not_shuffled(spark, tables, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_KEYS", 1)
    rows, first, _ = tables
    joined = lookups(rows, [(first, ["a"], "n")], ["id"])
    here = rows.select("id", F.input_file_name().alias("file"))
    placed = joined.select("id", "a", F.spark_partition_id().alias("place")).join(here, "id")
    kept = placed.filter("a = 'hot' OR a IS NULL").groupBy("place").agg(F.countDistinct("file").alias("files"))
    moved = placed.filter("a <> 'hot'").select("place").distinct()
    assert kept.join(moved, "place").count() == 0
    assert kept.agg(F.sum("files")).first()[0] == here.select("file").distinct().count()
