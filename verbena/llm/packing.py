"""Best-two-fit packing of documents into token sequences of a fixed length.

A document's ids and an end mark are cut into pieces of ``capacity`` tokens, the first of which may
be shorter. How pieces go together depends on their lengths alone, of which there are ``capacity``
at most, so the plan is made from a table of counts by length: fill a sequence greedily with the
longest piece that fits, then swap its shortest piece for two that fill the widened gap better, and
repeat that sequence as often as the counts allow. Spark counts the lengths, numbers the pieces of
each length in chunks of bounded size, and looks their places up in the plan.

Defined cases. A null text is the empty text: one piece, the end mark. A null id stays null; equal
rows are packed one by one. An empty table gives no pieces. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.support import ship, text_of
from verbena.llm.units import units_of
from verbena.session import written

CAPACITY = 1024
END = 2  # the id after each document
CHUNK = 4_000  # pieces that are numbered together


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter."""
    first = length % capacity or capacity
    ends = range(first, length + 1, capacity)
    return [(max(0, end - capacity) if end > first else 0, end) for end in ends]


def piece_rows(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    text: str = "text",
    key: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids_crc32, and ids if asked for."""
    ship(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids binary" if with_ids else ""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(tokenizer)
        for batch in batches:
            out: dict[str, list] = {
                k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "ids")
            }
            for row, value in enumerate(batch.column(1)):
                ids = units.ids(value.as_py()) + end
                for k, (a, b) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * a : 4 * b]
                    out["row"].append(row)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(own))
                    if with_ids:
                        out["ids"].append(own)
            columns = [
                batch.column(0).take(pa.array(out["row"], pa.int64())),
                pa.array(out["piece"], pa.int32()),
                pa.array(out["start"], pa.int64()),
                pa.array(out["length"], pa.int64()),
                pa.array(out["ids_crc32"], pa.int64()),
            ]
            columns += [pa.array(out["ids"], pa.binary())] if with_ids else []
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        pieces, schema
    )


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences follow each, from counts by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while (present := np.nonzero(left)[0]).size:
        free, room, lengths = left.copy(), capacity, []
        while room and (fitting := present[(present <= room) & (free[present] > 0)]).size:
            lengths.append(int(fitting[-1]))
            free[lengths[-1]] -= 1
            room -= lengths[-1]
        if room and len(lengths) > 1:
            wide = room + lengths[-1]
            usable = present[(present < wide) & (free[present] > 0)]
            if usable.size:
                # For each length the longest partner; a length needs two pieces to pair with itself.
                at = np.searchsorted(usable, wide - usable, "right") - 1
                own = (at == np.arange(usable.size)) & (free[usable] < 2)
                at = at - own
                total = np.where(at >= 0, usable + usable[np.maximum(at, 0)], 0)
                best = int(total.argmax())
                if total[best] > lengths[-1]:
                    lengths[-1:] = [int(usable[best]), int(usable[at[best]])]
        uses = Counter(lengths)
        times = min(int(left[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            left[length] -= n * times
        plan.append((lengths, times))
    return plan


def places_of(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length, a row for each run of pieces: first number, first sequence, offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    numbered: Counter = Counter()
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((numbered[length], sequence, offset))
            numbered[length] += times
            offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in runs.items()}


def placed(length: Column, number: Column, places: dict[int, np.ndarray]) -> Column:
    """Sequence and offset of the piece with that number among those of its length."""

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, number):
        import pandas as pd

        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for one in np.unique(lengths):
            here = np.nonzero(lengths == one)[0]
            runs = places[int(one)]
            at = np.searchsorted(runs[:, 0], numbers[here], "right") - 1
            sequence[here] = runs[at, 1] + numbers[here] - runs[at, 0]
            offset[here] = runs[at, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place(length, number)


def numbered(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Number the pieces of each length from 0; a length's pieces are numbered chunk by chunk.

    ``pieces`` is a written table. A piece is dealt to one of its length's chunks, of about ``CHUNK``
    pieces each, by where it stands in the files, so equal rows and null ids are dealt out as well.
    """
    chunks = F.lit([counts.get(k, 0) // CHUNK + 1 for k in range(max(counts, default=0) + 1)])
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    dealt = pieces.select("*", place.alias("place")).withColumn(
        "chunk", F.pmod(F.xxhash64("place"), F.get(chunks, F.col("length").cast("int")).cast("long"))
    )
    before = (
        dealt.groupBy("length", "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n"))
        .drop("n")
    )
    order = Window.partitionBy("length", "chunk").orderBy("place")
    inside = dealt.withColumn("inside", F.row_number().over(order) - 1)
    return inside.join(before, ["length", "chunk"]).withColumn(
        "number", F.col("before") + F.col("inside")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with the sequence and the offset each one gets."""
    names = pieces.columns
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = places_of(plan_bins(counts, capacity))
    rows = numbered(pieces, counts)
    at = placed(F.col("length"), F.col("number"), places)
    return rows.withColumn("at", at).select(
        *names, F.col("at")["sequence_id"].alias("sequence_id"), F.col("at")["offset"].alias("offset")
    )
