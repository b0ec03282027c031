"""Which text is seen when: shuffles, batches, modes and anchor draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.functions.text import seeded_hash
from verbena.operators.ordering import hash_rank


def shuffle_order(
    df: DataFrame, dataset: str, key: str, seed: int, epoch: int | str = 0
) -> DataFrame:
    """Add ``place``, the 1-based seeded place of each row in its data set.

    ``epoch`` is a number, or the name of an epoch column to shuffle by.
    """
    keys = [dataset, epoch] if isinstance(epoch, str) else [dataset]
    turn = F.col(epoch) if isinstance(epoch, str) else F.lit(epoch)
    hashed = df.withColumn("_hash", seeded_hash(seed, turn, F.col(key)))
    return hash_rank(hashed, keys, "_hash", [key], "place").drop("_hash")


def assign_batches(df: DataFrame, size: int, place: str = "place") -> DataFrame:
    """Add ``batch`` and ``slot``, both 0-based, from the place in the shuffle."""
    before = F.col(place) - 1
    return df.withColumn("batch", F.floor(before / size)).withColumn("slot", before % size)


def mode_of(epoch: Column, batch: Column) -> Column:
    """Modes alternate by batch, and each epoch starts with the other mode."""
    return F.when((epoch + batch) % 2 == 0, "decoder").otherwise("encoder")


def alternate_modes(df: DataFrame, epoch: str = "epoch", batch: str = "batch") -> DataFrame:
    """Add ``mode`` for 0-based epochs and batches."""
    return df.withColumn("mode", mode_of(F.col(epoch), F.col(batch)))


def modes_of_passes(df: DataFrame, pass_no: str = "pass_no") -> DataFrame:
    """Add ``mode`` for test passes: encoder first, then in turn."""
    return df.withColumn("mode", F.when(F.col(pass_no) % 2 == 0, "encoder").otherwise("decoder"))


def anchor_sample(
    batches: DataFrame, anchors: DataFrame, key: str, k: int, seed: int, batch: str = "batch"
) -> DataFrame:
    """k anchor rows for each batch: batch, draw, key.

    Anchors are shuffled once and dealt out in turn, starting over when they run out,
    so a batch finds its rows by their place and not by ranking all of them.
    """
    hashed = anchors.select(key, F.lit(0).alias("_all")).withColumn(
        "_hash", seeded_hash(seed, F.col(key))
    )
    placed = hash_rank(hashed, ["_all"], "_hash", [key], "_place").select(
        key, (F.col("_place") - 1).alias("_place")
    )
    stock = anchors.agg(F.count("*").alias("n")).scalar()
    wanted = batches.select(
        batch, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw")
    ).withColumn("_place", (F.col(batch) * k + F.col("draw")) % stock)
    return wanted.join(placed, "_place").select(batch, "draw", key)
