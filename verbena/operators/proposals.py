"""Settings to try next: draws where good trials lie, ranked by their density ratio."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.functions.text import seeded_hash, uniform
from verbena.operators.ordering import running, running_count, value_chunks
from verbena.operators.trials import bin_scores, graded_trials
from verbena.session import written


def _drawn_bin(bins: Column, hashed: Column) -> Column:
    """The bin a hash falls on; each is as wide as its good trials, plus one."""
    share = lambda b: b["good"] + 1
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda n, b: n + share(b))
    # Whole numbers, so every engine draws the same: hash / 2 ** 32 < share so far / all.
    number = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("decimal(20,0)")
    mark = (number * total.cast("decimal(18,0)") / F.lit(2**32).cast("decimal(11,0)")).cast("double")
    start = F.struct(
        F.lit(0).cast("long").alias("upto"), F.lit(None).cast(BIN).alias("found")
    )
    walked = F.aggregate(
        bins,
        start,
        lambda a, b: F.struct(
            (a["upto"] + share(b)).alias("upto"),
            F.when(a["found"].isNull() & (mark < a["upto"] + share(b)), b)
            .otherwise(a["found"])
            .alias("found"),
        ),
    )
    return walked["found"]


BIN = "struct<bin:bigint,good:bigint,score:double>"


def propose_trials(
    trials: DataFrame,
    study: str,
    trial: str,
    value: str,
    ranges: dict[str, tuple[float, float]],
    draws: int,
    keep: int,
    seed: int,
    share: float = 0.25,
) -> DataFrame:
    """For each study the ``keep`` best of ``draws`` settings drawn where its good trials lie.

    Each setting of ``ranges`` is drawn on its own: a log10 bin by its share of good trials (add-one),
    then a place in the bin, within the range. A proposal's ``score`` is the product of its bins' ratios of
    good to bad density; ties go to the smaller number of the draw. Gives study, place, draw, score and
    the settings. Draws are hashes of seed, setting, study and number, so every run draws the same.
    Trials without a value and settings that are null, NaN or not above zero are left out; a study
    without any in some setting gets no proposals. A study has few bins, as doubles have few exponents.
    """
    graded = written(graded_trials(trials, study, trial, value, list(ranges), share), "graded")
    tables = []
    for name in ranges:
        usable = graded.filter((F.col(name) > 0) & ~F.isnan(name) & (F.col(name) < float("inf")))
        binned = usable.select(study, "_good", F.floor(F.log10(name)).alias("bin"))
        entry = F.struct("bin", "good", "score").cast(BIN)
        scored = bin_scores(binned, study)
        tables.append(scored.groupBy(study).agg(F.array_sort(F.collect_list(entry)).alias(f"_bins_{name}")))
    bins = written(reduce(lambda a, b: a.join(b, study), tables), "bins")
    numbered = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    spread = numbered.repartition(F.xxhash64(study, "draw")) if draws > 10_000 else numbered
    picked = spread.select(
        study,
        "draw",
        *[
            _drawn_bin(F.col(f"_bins_{name}"), seeded_hash(seed, name, "bin", F.col(study), F.col("draw"))).alias(
                f"_bin_{name}"
            )
            for name in ranges
        ],
    )
    exponents = []
    for name, (low, high) in ranges.items():
        at = F.col(f"_bin_{name}.bin")
        begin = F.greatest(at.cast("double"), F.lit(math.log10(low)))
        end = F.least(at + F.lit(1.0), F.lit(math.log10(high)))
        place = uniform(seeded_hash(seed, name, "place", F.col(study), F.col("draw")))
        exponents.append(F.pow(F.lit(10.0), begin + place * (end - begin)).alias(name))
    score = reduce(lambda a, b: a * b, [F.col(f"_bin_{name}.score") for name in ranges])
    proposals = picked.select(study, "draw", score.alias("score"), *exponents)
    ordered = value_chunks(proposals.withColumn("_cost", -F.col("score")), [study], ["_cost", "draw"])
    placed = running(ordered, [study], "_chunk", ["_cost", "draw"], {"place": running_count()})
    return placed.filter(F.col("place") <= keep).select(study, "place", "draw", "score", *ranges)
