"""Running measures and ranks that never sort a whole group in one task.

A group (one run, one data set, one study) may hold a third of all rows. Every
function here cuts a group into ordered chunks, works inside each chunk, and
adds what the earlier chunks of the group hold: a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.session import written

CHUNK_ROWS = 100_000


@dataclass(frozen=True)
class Measure:
    """An associative running measure.

    ``total`` aggregates rows, ``fold`` aggregates chunk totals, ``merge`` joins
    the total of the earlier chunks with the one inside the chunk. With
    ``before`` set, the current row does not count.
    """

    total: Column
    fold: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    before: bool = False


def running_sum(value: Column, before: bool = False) -> Measure:
    zero = F.lit(0)
    return Measure(
        F.sum(value), F.sum, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), before
    )


def running_count(before: bool = False) -> Measure:
    return running_sum(F.lit(1), before)


def running_min(value: Column, before: bool = False) -> Measure:
    return Measure(F.min(value), F.min, F.least, before)


def running_max(value: Column, before: bool = False) -> Measure:
    return Measure(F.max(value), F.max, F.greatest, before)


def running(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    measures: dict[str, Measure],
) -> DataFrame:
    """Add running measures over ``keys``, in the order of (chunk, order).

    ``chunk`` must not fall as ``order`` rises. Rows are shuffled by (keys, chunk),
    so a hot group is spread over as many tasks as it has chunks. Null keys are a group
    of their own, and a null chunk comes first.
    """
    group = Window.partitionBy(*keys, chunk).orderBy(*order)
    inside = {
        False: group.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        True: group.rowsBetween(Window.unboundedPreceding, -1),
    }
    earlier = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*keys, chunk).agg(
        *[m.total.alias(f"_total_{name}") for name, m in measures.items()]
    )
    carried = totals.select(
        *keys,
        chunk,
        *[
            m.fold(F.col(f"_total_{name}")).over(earlier).alias(f"_carried_{name}")
            for name, m in measures.items()
        ],
    )
    rows = df.select(
        "*",
        *[m.total.over(inside[m.before]).alias(f"_inside_{n}") for n, m in measures.items()],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*keys, chunk)]
    earlier_chunks = carried.withColumnsRenamed({c: f"_at_{c}" for c in (*keys, chunk)})
    return rows.join(earlier_chunks, same).select(
        *df.columns,
        *[
            m.merge(F.col(f"_carried_{name}"), F.col(f"_inside_{name}")).alias(name)
            for name, m in measures.items()
        ],
    )


def hash_rank(
    df: DataFrame,
    keys: list[str],
    hashed: str,
    tiebreak: list[str],
    rank: str,
    digits: int | None = None,
) -> DataFrame:
    """1-based rank inside ``keys`` by an md5 column.

    The leading hex digits are the chunk: 16**digits even shares of every group, so many
    that a group of all rows has about ``CHUNK_ROWS`` in each.
    """
    if digits is None:
        digits = 1
        rows = df.count()
        while rows > CHUNK_ROWS * 16**digits:
            digits += 1
    chunked = df.withColumn("_chunk", F.substring(hashed, 1, digits))
    ranked = running(chunked, keys, "_chunk", [hashed, *tiebreak], {rank: running_count()})
    return ranked.drop("_chunk")


def value_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_chunk``: range partitions of (keys, order), for any orderable value.

    Range bounds come from a sample, so the chunks are fixed in a written table before
    anything is counted by them. ``order`` should end in a unique column.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id())
    return written(ranged, "ranges")
