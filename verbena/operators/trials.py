"""Search over settings: draws, journals, budgets, best trials, pruning, ranges."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions.text import seeded_hash, uniform
from verbena.operators.joins import lookup
from verbena.operators.ordering import running, running_count, running_sum, value_chunks
from verbena.session import written


def has_value(value: str) -> Column:
    """Whether a trial or step has a value: one that is neither null nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(value)


def log_uniform(hashed: Column, low: float, high: float) -> Column:
    """A draw whose logarithm is uniform between the logarithms of the bounds."""
    lo, hi = math.log(low), math.log(high)
    return F.exp(F.lit(lo) + uniform(hashed) * F.lit(hi - lo))


def with_log_uniform(
    trials: DataFrame, trial: str, ranges: dict[str, tuple[float, float]], seed: int
) -> DataFrame:
    """Add one log-uniform column per range, drawn from seed, name and trial."""
    return trials.select(
        "*",
        *[
            log_uniform(seeded_hash(seed, name, F.col(trial)), low, high).alias(name)
            for name, (low, high) in ranges.items()
        ],
    )


def log_uniform_trials(
    spark: SparkSession, n: int, ranges: dict[str, tuple[float, float]], seed: int
) -> DataFrame:
    """n trials, numbered from 0."""
    return with_log_uniform(spark.range(n).withColumnRenamed("id", "trial"), "trial", ranges, seed)


def latest_trial_state(log: DataFrame, by: list[str], seq: str, values: list[str]) -> DataFrame:
    """Replay an append-only journal: the last entry of each trial.

    To resume, pass the union of the old log and the new one.
    """
    entry = F.struct(F.col(seq), *values)
    return log.groupBy(*by).agg(F.max(entry).alias("_last")).select(*by, "_last.*")


def best_trial(trials: DataFrame, study: str, value: str) -> DataFrame:
    """The trials with the lowest value of their study, all of them if they tie.

    A running or failed trial has no value (null or NaN) and is never the best.
    """
    trials = trials.filter(has_value(value))
    held = trials.groupBy(study, value).agg(F.count("*").alias("_degree"))
    lowest = (
        held.groupBy(study)
        .agg(F.min(F.struct(value, "_degree")).alias("_low"))
        .select(study, "_low.*", F.lit(True).alias("_lowest"))
    )
    ids = [c for c in trials.columns if c not in (study, value)]
    found = lookup(trials, written(lowest, "lowest"), [study, value], ids, "_degree")
    return found.filter("_lowest").drop("_lowest")


def trial_budget(
    trials: DataFrame,
    study: str,
    order: list[str],
    max_trials: int,
    finished: Column,
) -> DataFrame:
    """The first ``max_trials`` finished trials of each study, for a budget of any size.

    Trials are counted over range partitions, so a study of any size is split.
    """
    cut = value_chunks(trials.filter(finished), [study], order)
    ranked = running(cut, [study], "_chunk", order, {"place": running_count()})
    return ranked.filter(F.col("place") <= max_trials).drop("_chunk")


def _best_steps(steps: DataFrame, study: str, trial: str, step: str, loss: str) -> DataFrame:
    reached = steps.filter(has_value(loss)).groupBy(study, trial).agg(
        F.min(loss).alias("_low"), F.count("*").alias("_degree")
    )
    chosen = (
        reached.groupBy(study)
        .agg(F.min(F.struct("_low", trial, "_degree")).alias("_best"))
        .select(
            study,
            F.col(f"_best.{trial}").alias(trial),
            F.col("_best._degree").alias("_degree"),
            F.lit(True).alias("_chosen"),
        )
    )
    found = lookup(steps, written(chosen, "chosen"), [study, trial], [step], "_degree")
    return found.filter("_chosen").select(
        study, step, F.col(loss).alias("best_loss"), F.col(trial).alias("best_trial")
    )


def signed_rank(
    differences: DataFrame, keys: list[str], difference: str = "difference"
) -> DataFrame:
    """Wilcoxon's signed rank per key: m, w_plus, w_minus, z.

    Zeros are dropped and ties get their mean rank. Equal sizes are counted first, then
    the distinct sizes are ranked over range partitions, so a key of any length is split.
    """
    size = F.abs(F.col(difference))
    counted = (
        differences.filter(F.col(difference) != 0)
        .groupBy(*keys, size.alias("_size"))
        .agg(F.count("*").alias("_n"), F.count_if(F.col(difference) > 0).alias("_up"))
    )
    cut = value_chunks(counted, keys, ["_size"])
    placed = running(
        cut, keys, "_chunk", ["_size"], {"_below": running_sum(F.col("_n"), before=True)}
    )
    rank = F.col("_below") + (F.col("_n") + 1) / 2
    sums = placed.groupBy(*keys).agg(
        F.sum("_n").alias("m"),
        F.sum(F.col("_up") * rank).alias("w_plus"),
        F.sum((F.col("_n") - F.col("_up")) * rank).alias("w_minus"),
        F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("_ties"),
    )
    m = F.col("m").cast("double")
    mean = m * (m + 1) / 4
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48
    z = F.when(variance > 0, (F.col("w_plus") - mean) / F.sqrt(variance))
    return sums.select(*keys, "m", "w_plus", "w_minus", z.alias("z"))


def step_differences(
    steps: DataFrame, study: str, trial: str, step: str, loss: str
) -> DataFrame:
    """Loss of each trial minus that of its study's best trial at the same step.

    A step is shared by all trials of a study, so it is a hot key by nature.
    """
    best = _best_steps(steps, study, trial, step, loss)
    steps = steps.filter(has_value(loss))
    paired = lookup(steps, written(best, "best-steps"), [study, step], [trial, step])
    return paired.filter(F.col("best_trial") != F.col(trial)).select(
        study, trial, step, (F.col(loss) - F.col("best_loss")).alias("difference")
    )


def prune_trials(
    steps: DataFrame,
    study: str,
    trial: str,
    step: str,
    loss: str,
    startup: int = 0,
    p_threshold: float = 0.1,
) -> DataFrame:
    """Signed-rank test of each trial against the best one; ``pruned`` if it is worse.

    Steps without a loss (null or NaN) are left out, so a trial of such steps alone is
    neither the best nor tested. A trial with fewer than ``startup`` steps in common with the best one is kept.
    """
    limit = NormalDist().inv_cdf(1 - p_threshold)
    differences = step_differences(steps, study, trial, step, loss)
    compared = differences.groupBy(study, trial).agg(F.count("*").alias("steps"))
    tested = signed_rank(differences, [study, trial])
    return compared.join(tested, [study, trial], "left").withColumn(
        "pruned",
        F.coalesce((F.col("z") > limit) & (F.col("steps") >= startup), F.lit(False)),
    )


def graded_trials(
    trials: DataFrame, study: str, trial: str, value: str, settings: list[str], share: float
) -> DataFrame:
    """``study``, the settings and ``_good``: whether a trial is among its study's best ``share``.

    Ties go to the smaller trial; trials without a value (null or NaN) are left out.
    """
    rows = trials.filter(has_value(value)).select(study, trial, value, *settings)
    cut = value_chunks(rows, [study], [value, trial])
    placed = running(cut, [study], "_chunk", [value, trial], {"_place": running_count()})
    sizes = rows.groupBy(study).agg(F.count("*").alias("_all"), F.count("*").alias("_degree"))
    graded = lookup(placed, written(sizes, "sizes"), [study], [trial], "_degree")
    good = F.col("_place") <= F.ceil(F.col("_all") * share)
    return graded.select(study, *settings, good.alias("_good"))


def bin_scores(graded: DataFrame, study: str) -> DataFrame:
    """Good and bad trials of each study and ``bin``, and the ratio of their add-one shares."""
    bins = graded.groupBy(study, "bin").agg(
        F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")
    )
    whole = bins.groupBy(study).agg(
        F.sum("good").alias("_good"), F.sum("bad").alias("_bad"), F.count("*").alias("_bins")
    )
    ratio = ((F.col("good") + 1) / (F.col("_good") + F.col("_bins"))) / (
        (F.col("bad") + 1) / (F.col("_bad") + F.col("_bins"))
    )
    return bins.join(whole, study).select(study, "bin", "good", "bad", ratio.alias("score"))


def range_scores(
    trials: DataFrame, study: str, trial: str, value: str, setting: str, share: float = 0.25
) -> DataFrame:
    """Where good settings lie: good and bad trials per log10 bin and their density ratio.

    The best ``share`` of a study's trials are good, ties by trial; shares are add-one.
    Trials without a value (null or NaN) are left out: they are neither good nor bad.
    """
    graded = graded_trials(trials, study, trial, value, [setting], share)
    binned = graded.select(study, "_good", F.floor(F.log10(setting)).alias("bin"))
    return bin_scores(binned, study)
