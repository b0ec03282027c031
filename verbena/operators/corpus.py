"""Roles and names of corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_role(
    df: DataFrame, mapping: dict[str, str], source: str = "source", default: str | None = None
) -> DataFrame:
    """Add ``role`` (train, validation, test, anchor) by source.

    The mapping is part of the plan; a source without a role and without a default is
    dropped.
    """
    sources: dict[str, list[str]] = {}
    for name, role in mapping.items():
        sources.setdefault(role, []).append(name)
    chosen = F.lit(default).cast("string")
    for role, names in sources.items():
        chosen = F.when(F.col(source).isin(*names), role).otherwise(chosen)
    tagged = df.withColumn("role", chosen)
    return tagged if default is not None else tagged.filter(F.col("role").isNotNull())


def parse_dataset_name(df: DataFrame, path: str) -> DataFrame:
    """Add the parts of a data set's name, taken from its name or its path.

    Names read [syn_]<verb>_[<construction>_]<order>_<task>_for_human_exp[_<variant>];
    fixed names leave the parts null.
    """
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.txt(\.gz)?$", "")
    pattern = (
        r"^(syn_)?([a-z]+)_(?:([a-z]+)_)?(SVO-OSV|ext)_([a-z]+)_for_human_exp(?:_(.+))?$"
    )

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract("dataset", pattern, i), F.lit(""))

    return df.withColumn("dataset", name).select(
        "*",
        F.when(F.col("dataset").rlike(pattern), part(1).isNotNull()).alias("synthetic"),
        part(2).alias("verb"),
        part(3).alias("construction"),
        part(4).alias("word_order"),
        part(5).alias("task"),
        part(6).alias("variant"),
    )


def all_tests(tests: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Bag union of test corpora under their names; repeated rows stay."""
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("dataset"), *columns) for name, df in tests.items()],
    )
