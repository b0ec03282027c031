"""Factorial designs of runs: plan, gaps, audit, comparison and summaries."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.operators.joins import lookup
from verbena.operators.ordering import hash_rank
from verbena.session import written

# The coordinates of the planned grid of runs.
MODELS = [
    "gpt2",
    "EleutherAI-pythia-2.8b",
    "meta-llama-Llama-3.2-1B",
    "allenai-OLMo-2-0425-1B",
    "ltg-gpt-bert-babylm-base-lm",
    "ltg-gpt-bert-babylm-base-mlm",
    "ltg-gpt-bert-babylm-base-lm+mlm",
]
VERBS = [
    "blorked",
    "crined",
    "dafed",
    "irriticiated",
    "miticurized",
    "onstigipated",
    "peagified",
    "piliciated",
    "smeshed",
    "squailed",
    "unseffed",
]
TASKS = ["dr", "bv", "wr"]
SEEDS = list(range(40))


def expand_grid(spark: SparkSession, dims: dict[str, list | DataFrame]) -> DataFrame:
    """Every combination of the dimensions, each a list or a one-column table.

    Cells are numbered and each number is read as one digit per dimension. So the cells
    are made by all tasks alike, and a table dimension is joined on its digit.
    """
    sizes, levels = {}, {}
    for name, values in dims.items():
        if isinstance(values, DataFrame):
            distinct = values.select(F.col(values.columns[0]).alias(name)).distinct()
            marked = written(distinct, name).select(
                name, F.lit(0).alias("_all"), F.md5(F.col(name).cast("string")).alias("_hash")
            )
            ranked = hash_rank(marked, ["_all"], "_hash", [name], "_level")
            digits = ranked.select(name, (F.col("_level") - 1).alias(f"_{name}"))
            levels[name] = written(digits, name)
            sizes[name] = levels[name].count()
        else:
            sizes[name] = len(values)
    grid = spark.range(prod(sizes.values()))
    stride = 1
    for name in reversed(list(dims)):
        digit = F.expr(f"id div {stride}") % sizes[name]
        grid = grid.withColumn(f"_{name}", digit)
        stride *= sizes[name]
    for name, values in dims.items():
        if name in levels:
            # A dimension of three levels has keys that hold a third of all cells each.
            grid = lookup(grid, levels[name], [f"_{name}"], ["id"])
        else:
            grid = grid.withColumn(
                name, F.element_at(F.lit(values), F.col(f"_{name}").cast("int") + 1)
            )
    return grid.select(*dims)


def grid_gaps(planned: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Planned cells that are not there."""
    return planned.join(present.select(*on).distinct(), on, "left_anti").select(*on)


def parse_run_name(df: DataFrame, name: str) -> DataFrame:
    """Add name_model, name_verb, name_task and name_seed from <model>-<verb>-<task>-<seed>."""
    pattern = r"^(.+)-([a-z]+)-([a-z]+)-(\d+)$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))

    return df.select(
        "*",
        part(1).alias("name_model"),
        part(2).alias("name_verb"),
        part(3).alias("name_task"),
        part(4).cast("int").alias("name_seed"),
    )


def audit_runs(
    by_name: DataFrame, by_content: DataFrame, run: str, fields: list[str]
) -> DataFrame:
    """Runs whose name and content disagree: run, field, in_name, in_content.

    A run that has only a name or only content disagrees in every field the other side has.
    """
    left = by_name.select(run, *[F.col(f).alias(f"_name_{f}") for f in fields])
    right = by_content.select(run, *[F.col(f).alias(f"_content_{f}") for f in fields])
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"_name_{f}").cast("string").alias("in_name"),
                F.col(f"_content_{f}").cast("string").alias("in_content"),
            )
            for f in fields
        ]
    )
    return (
        left.join(right, run, "full")
        .select(run, F.inline(pairs))
        .filter(~F.col("in_name").eqNullSafe(F.col("in_content")))
    )


def pair_with_baseline(
    run_scores: DataFrame,
    base_scores: DataFrame,
    on: list[str],
    score: str = "score",
    keep_unmatched: bool = True,
) -> DataFrame:
    """Score, base score and their difference per test item.

    Both tables have one row per item. Not every model has a baseline, so unmatched
    items are kept unless told otherwise.
    """
    base = base_scores.select(*on, F.col(score).alias(f"base_{score}"))
    paired = run_scores.join(base, on, "left" if keep_unmatched else "inner")
    return paired.withColumn("delta", F.col(score) - F.col(f"base_{score}"))


def seed_summary(scores: DataFrame, cell: list[str], score: str = "score") -> DataFrame:
    """n, mean, sd and standard error over the seeds of each cell."""
    return scores.groupBy(*cell).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("sd"),
        (F.stddev_samp(score) / F.sqrt(F.nullif(F.count(score), F.lit(0)))).alias("se"),
    )


def condition_cube(
    scores: DataFrame, dims: list[str], score: str = "score", rollup: bool = False
) -> DataFrame:
    """Margins over all sets of dimensions (or over their prefixes), with the level."""
    grouped = scores.rollup(*dims) if rollup else scores.cube(*dims)
    return grouped.agg(
        F.grouping_id(*dims).alias("level"),
        F.count("*").alias("n"),
        F.avg(score).alias("mean"),
    )


def grid_counts(runs: DataFrame, by: list[str], seed: str = "seed") -> DataFrame:
    """Runs present, distinct seeds and seed range."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.countDistinct(seed).alias("seeds"),
        F.min(seed).alias("min_seed"),
        F.max(seed).alias("max_seed"),
    )
