"""Pruning while trials run: the step at which a signed-rank test first speaks against a trial.

Among differences without zeros, the rank sum of the positive ones is the number of pairs (a
difference with itself included) whose sum is positive, where a sum of zero counts half. So the rank sum
grows with each step by what that step adds: one if its difference is positive, and the earlier
differences that exceed its negative. That order statistic is counted block by block: at level
``l`` the steps of a trial form blocks of ``2**l``, and each step of a right block counts in the left
one beside it. Every pair of steps meets at exactly one level, so ``n`` steps cost ``n log n``
rows and no pairs. Counts are running sums over range partitions, so a trial of any length is split.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.operators.joins import lookup
from verbena.operators.ordering import running, running_count, running_sum, value_chunks
from verbena.operators.trials import step_differences
from verbena.session import written


def _earlier_pairs(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Twice the earlier rows whose sum with a row is positive, plus those where it is zero.

    ``rows``: keys, step, difference (not zero), ``_place`` from 0, ``_m`` rows of the group.
    Gives keys, step and ``_twice`` for one or more rows a step, to be added up.
    """
    levels = F.expr("sequence(0, length(bin(_m - 1)) - 1)")
    block = F.expr("shiftright(_place, _level + 1)")
    half = F.expr("shiftleft(1L, _level)")
    right = F.expr("shiftright(_place, _level) & 1") == 1
    # Sorted by value, a question before and one after equal points asks for fewer and for no more.
    point = F.array(F.struct(F.col("difference").alias("v"), F.lit(1).alias("at")))
    asks = F.array(*[F.struct((-F.col("difference")).alias("v"), F.lit(k).alias("at")) for k in (0, 2)])
    probes = (
        rows.filter("_m > 1")
        .select("*", F.explode(levels).alias("_level"))
        .select("*", block.alias("_block"), half.alias("_half"), right.alias("_right"))
        .filter(F.col("_right") | (F.col("_block") * 2 * F.col("_half") + F.col("_half") < F.col("_m")))
        .select(*keys, step, "_level", "_block", "_half", F.explode(F.when(F.col("_right"), asks).otherwise(point)).alias("_p"))
        .select(*keys, step, "_level", "_block", "_half", F.col("_p.v").alias("_v"), F.col("_p.at").alias("_at"))
    )
    group = [*keys, "_level", "_block"]
    cut = value_chunks(probes, group, ["_v", "_at", step])
    is_point = (F.col("_at") == 1).cast("long")
    counted = running(cut, group, "_chunk", ["_v", "_at"], {"_below": running_sum(is_point, before=True)})
    return counted.filter(F.col("_at") != 1).select(
        *keys, step, (F.col("_half") - F.col("_below")).alias("_twice")
    )


def running_signed_rank(differences: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Wilcoxon's signed rank after each step: keys, step, steps, m, w_plus, w_minus, z.

    ``differences`` has the columns of ``keys``, ``step`` and ``difference``, one row a step. ``steps``
    counts all so far, ``m`` those that are not zero. A difference that is no number (of two
    infinite losses) is a zero; rows without a difference are left out. ``z`` is null while no rank differs.
    """
    difference = F.when(F.isnan("difference"), 0.0).otherwise(F.col("difference"))
    rows = differences.filter(F.col("difference").isNotNull()).select(
        *keys, step, difference.alias("difference"), (difference != 0).cast("long").alias("_counts")
    )
    ordered = value_chunks(rows, keys, [step])
    placed = running(ordered, keys, "_chunk", [step], {"_place": running_sum(F.col("_counts"), before=True)})
    some = placed.filter("_counts = 1").drop("_chunk", "_counts")
    sized = value_chunks(some.withColumn("_size", F.abs("difference")), [*keys, "_size"], [step])
    same = running(sized, [*keys, "_size"], "_chunk", [step], {"_same": running_count(before=True)})
    same = written(same.drop("_chunk", "_size"), "sized")
    lengths = same.groupBy(*keys).agg(F.count("*").alias("_m"), F.count("*").alias("_degree"))
    long = lookup(same, written(lengths, "lengths"), keys, [step], "_degree")
    zero = F.lit(0).cast("long")
    # Ties take m ** 3 - m of each size off the variance; one more adds 3 m ** 2 + 3 m.
    own = same.select(
        *keys,
        step,
        (F.col("difference") > 0).cast("long").alias("_twice") * 2,
        (F.col("_same") * (F.col("_same") + 1) * 3).alias("_ties"),
        F.lit(1).cast("long").alias("_m"),
        zero.alias("_n"),
    ).toDF(*keys, step, "_twice", "_ties", "_m", "_n")
    pairs = _earlier_pairs(long, keys, step).select(
        *keys, step, "_twice", zero.alias("_ties"), zero.alias("_m"), zero.alias("_n")
    )
    every = rows.select(
        *keys, step, zero.alias("_twice"), zero.alias("_ties"), zero.alias("_m"), F.lit(1).cast("long").alias("_n")
    )
    sums = ["_twice", "_ties", "_m", "_n"]
    by_step = every.unionByName(own).unionByName(pairs).groupBy(*keys, step).agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    cut = value_chunks(by_step, keys, [step])
    so_far = running(cut, keys, "_chunk", [step], {f"{c}_sum": running_sum(F.col(c)) for c in sums})
    m = F.col("_m_sum").cast("double")
    plus = F.col("_twice_sum") / 2
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties_sum") / 48
    z = F.when(variance > 0, (plus - m * (m + 1) / 4) / F.sqrt(variance))
    return so_far.select(
        *keys,
        step,
        F.col("_n_sum").alias("steps"),
        F.col("_m_sum").alias("m"),
        plus.alias("w_plus"),
        (m * (m + 1) / 2 - plus).alias("w_minus"),
        z.alias("z"),
    )


def prune_running(
    steps: DataFrame,
    study: str,
    trial: str,
    step: str,
    loss: str,
    startup: int = 0,
    p_threshold: float = 0.1,
) -> DataFrame:
    """Per trial the first step at which the signed-rank test against the best trial prunes it.

    Gives study, trial, ``pruned_at`` (null: never), the steps compared by then and ``z`` then (null both
    if never). A trial is tested after each step it shares with the best trial, from the ``startup``-th on.
    Steps without a loss (null or NaN) are left out.
    """
    limit = NormalDist().inv_cdf(1 - p_threshold)
    differences = written(step_differences(steps, study, trial, step, loss), "differences")
    tested = running_signed_rank(differences, [study, trial], step)
    spoken = (F.col("z") > limit) & (F.col("steps") >= startup)
    first = tested.groupBy(study, trial).agg(
        F.min(F.when(spoken, F.struct(F.col(step).alias("at"), "steps", "z"))).alias("_first")
    )
    return first.select(
        study,
        trial,
        F.col("_first.at").alias("pruned_at"),
        F.col("_first.steps").alias("steps"),
        F.col("_first.z").alias("z"),
    )
