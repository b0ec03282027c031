"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]

#: A run of white space, as a regular expression of both Java and RE2, and a word.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    """The text column; null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, GAP), "")


def spare(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2`` ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    k, out = 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session.

    Functions that run in tasks are found there by import, whatever folder a worker starts in.
    """
    context = spark.sparkContext
    if getattr(context, "_verbena_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(PACKAGE.parent).as_posix())
    target = os.path.join(tempfile.mkdtemp(prefix="verbena-"), "verbena.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)
    context._verbena_shipped = True
