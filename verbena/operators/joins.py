"""A left join that survives hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.session import written

HOT_KEYS = 100_000
BROADCAST_BYTES = 16_000_000
STEPS = 8  # degrees are told apart by this many steps for each power of two


def is_small(df: DataFrame) -> bool:
    """Whether a written table may be broadcast whole, by the bytes of its files.

    The optimizer knows them from the file listing, so no job is run.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= BROADCAST_BYTES


def _step(degree: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(degree), F.lit(1))) * STEPS)


def hot_rows(right: DataFrame, degree: str) -> DataFrame:
    """The rows of highest ``degree``, at most HOT_KEYS: all from some step of degrees up.

    A step is taken whole or not at all, so the rows need no sorting in one task. More than
    HOT_KEYS keys of the highest step are none of them hot.
    """
    steps = right.filter(F.col(degree) > 0).groupBy(_step(degree).alias("step"))
    listed = F.sort_array(F.collect_list(F.struct("step", "count")), asc=False)
    least, keys = None, 0
    for row in steps.count().agg(listed.alias("steps")).first()["steps"]:
        keys += row["count"]
        if keys > HOT_KEYS:
            break
        least = row["step"]
    return right.filter(F.lit(False) if least is None else (F.col(degree) > 0) & (_step(degree) >= least))


def _missing(on: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])


def hot_key_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    degree: str,
    salt: list[str],
    values: list[str] | None = None,
) -> DataFrame:
    """Left join to a table with one row per key, exact for any skew of ``left``.

    ``degree`` in ``right`` counts the rows of ``left`` that hold the key. The rows of the
    keys of highest degree are broadcast, and what holds one of them, or no key, stays where
    it is. Only the other rows go through a shuffle join. ``left`` is read twice for that.
    ``salt`` is not needed by one table; see ``hot_key_joins``.
    """
    values = values or [c for c in right.columns if c not in (*on, degree)]
    return hot_key_joins(left, [(right, hot_rows(right, degree), on, values)], salt)


def hot_key_joins(
    left: DataFrame,
    tables: list[tuple[DataFrame, DataFrame, list[str], list[str]]],
    salt: list[str],
) -> DataFrame:
    """Left joins to several tables (all rows, hot rows, on, values), none on another's values.

    Rows whose keys are all hot or missing don't move. The others meet the tables in turn; where
    a key of theirs is settled they are passengers, dealt out by a hash of ``salt``, columns
    that differ between the rows of one key.
    """
    near, settled = left, []
    for i, (_, hot, on, values) in enumerate(tables):
        packed = F.struct(*values).alias(f"_hot_{i}")
        near = near.join(F.broadcast(hot.select(*on, packed)), on, "left")
        settled.append(F.col(f"_hot_{i}").isNotNull() | _missing(on))
    done = reduce(lambda a, b: a & b, settled)
    cold = near.filter(~done)
    for i, (right, _, on, values) in enumerate(tables):
        never = F.lit(0).cast("bigint")
        passenger = F.when(settled[i], F.xxhash64(*salt)).otherwise(never) if len(tables) > 1 else never
        packed = F.struct(*values).alias(f"_cold_{i}")
        every = right.select(*on, packed, never.alias("_salt"))
        cold = cold.withColumn("_salt", passenger).join(every, [*on, "_salt"], "left")
        cold = cold.withColumn(f"_hot_{i}", F.coalesce(f"_hot_{i}", f"_cold_{i}")).drop("_salt", f"_cold_{i}")
    found = [
        F.col(f"_hot_{i}.{v}").alias(v) for i, table in enumerate(tables) for v in table[3]
    ]
    columns = [F.col(c) for c in left.columns] + found
    return near.filter(done).select(*columns).unionByName(cold.select(*columns))


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    salt: list[str],
    degree: str | None = None,
) -> DataFrame:
    """Left join to a written table with one row per key.

    A table that is small by its files is broadcast, and no row of ``left`` moves.
    Any other goes through ``hot_key_join``; the degrees are counted unless ``right``
    has them.
    """
    return lookups(left, [(right, on, degree)], salt)


def lookups(
    left: DataFrame, tables: list[tuple[DataFrame, list[str], str | None]], salt: list[str]
) -> DataFrame:
    """``lookup`` in several written tables (right, on, degree), none on another's values.

    ``left`` should be a written table too, as its keys are counted and its rows read twice.
    """
    small, large, columns = left, [], list(left.columns)
    for right, on, degree in tables:
        values = [c for c in right.columns if c not in (*on, degree)]
        columns += values
        if is_small(right):
            small = small.join(F.broadcast(right.select(*on, *values)), on, "left")
        elif degree is not None:
            large.append((right, hot_rows(right, degree), on, values))
        else:
            held = left.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("_degree"))
            most = F.broadcast(hot_rows(written(held, "degrees"), "_degree").drop("_degree"))
            large.append((right, right.join(most, on, "left_semi"), on, values))
    return (hot_key_joins(small, large, salt) if large else small).select(*columns)
