"""Tokens, neighbouring tokens and rebuilt text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verbena.functions.text import tokens_of


def tokenize(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per token: keys, pos (0-based), token."""
    return df.select(*keys, F.posexplode(tokens_of(text)).alias("pos", "token"))


def neighbours(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Tokens with the one before and the one after, found without a shuffle.

    The shifted copies are made inside each text's own array; a window over
    (text, pos) would sort and move every token of the corpus.
    """
    words = df.select(*keys, tokens_of(text).alias("_words"))
    count = F.size("_words")
    aligned = F.arrays_zip(
        F.concat(F.array(F.lit(None).cast("string")), F.col("_words")).alias("prev"),
        F.col("_words").alias("token"),
        F.slice("_words", F.lit(2), F.greatest(count - 1, F.lit(0))).alias("next"),
    )
    return (
        words.select(*keys, F.posexplode(aligned).alias("pos", "_at"))
        .select(*keys, "pos", "_at.prev", "_at.token", "_at.next")
        .filter(F.col("token").isNotNull())
    )


def _runs(batch: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    """Rows in a row of one text and of consecutive positions as one: keys, pos, size, text.

    A token that is null, empty or holds a blank, or has no position, stays by itself.
    """
    pos, token = batch.column("pos"), batch.column("token")
    alone = pc.or_(pc.is_null(pos), pc.fill_null(pc.or_(pc.match_substring(token, " "), pc.equal(token, "")), True))
    alone = alone.to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.cast(pos, pa.int64()), 0).to_numpy(zero_copy_only=False)
    new = alone.copy()
    new[0] = True
    new[1:] |= alone[:-1] | (at[1:] != at[:-1] + 1)
    for k in keys:
        try:
            code = pc.fill_null(batch.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        except (pa.ArrowNotImplementedError, AttributeError):  # a nested key
            new[:] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(new)), pa.int64()), token)
    first = batch.take(pa.array(starts))
    columns = [*[first.column(k) for k in keys], pc.cast(first.column("pos"), pa.int64())]
    columns += [pa.array(ends - starts, pa.int64()), pc.cast(pc.binary_join(lists, " "), pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*keys, "pos", "size", "text"])


def rebuild_text(
    tokens: DataFrame, keys: list[str], texts: DataFrame | None = None
) -> DataFrame:
    """Join the tokens of each text back together by position.

    A group is one text, which was one row before it was split. Tokens that still lie side by side
    are joined before they move. Texts without a token have no
    row among the tokens; with the table of all ``texts`` (its keys) they come back empty.
    """
    rows = tokens.select(*keys, "pos", "token")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _runs(batch, keys)

    types = [rows.schema[k] for k in keys]
    schema = StructType(types).add("pos", "long").add("size", "long").add("text", "string")
    run = F.struct("pos", "size", "text").alias("run")
    known = F.lit(True).alias("known")
    runs = rows.mapInArrow(joined, schema).select(*keys, run, F.lit(texts is None).alias("known"))
    if texts is not None:
        empty = F.lit(None).cast("struct<pos:bigint,size:bigint,text:string>").alias("run")
        runs = runs.unionByName(texts.select(*keys, empty, known))
    met = runs.groupBy(*keys).agg(
        F.array_sort(F.collect_list("run")).alias("runs"), F.max("known").alias("known")
    )
    # Runs that overlap, of a text that came twice, are taken apart and sorted by token.
    overlapping = F.exists(
        F.sequence(F.lit(1), F.size("runs") - 1),
        lambda i: F.coalesce(
            F.get("runs", i - 1)["pos"] + F.get("runs", i - 1)["size"] > F.get("runs", i)["pos"], F.lit(True)
        ),
    )
    apart = F.flatten(
        F.transform(
            "runs",
            lambda r: F.transform(
                F.when(r["size"] == 1, F.array(r["text"])).otherwise(F.split(r["text"], " ")),
                lambda t, i: F.struct((r["pos"] + i).alias("pos"), t.alias("token")),
            ),
        )
    )
    plain = F.array_join(F.transform("runs", lambda r: r["text"]), " ")
    mixed = F.array_join(F.transform(F.array_sort(apart), lambda at: at["token"]), " ")
    text = F.when((F.size("runs") > 1) & overlapping, mixed).otherwise(plain)
    return met.filter("known").select(*keys, text.alias("text"))
