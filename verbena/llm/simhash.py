"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into two halves. If two fingerprints differ in at most three bits, one of
their halves differs in at most one. For each half the anchors are the words of a Hamming code on
31 bits and the free 32nd bit: every half lies within one bit of an anchor (the covering radius).
A fingerprint visits all anchors within radius plus one (2 or 17 of the 2**27) and is at home at
the nearest. Fingerprints that differ in one bit of a half meet where one of them is at home, so
only those are compared: a join on half and anchor with the bit count as its condition.

Only distinct fingerprints are compared, and the links are joined to groups by
:func:`verbena.llm.components.components`, so copies are never paired.

Defined cases. A null or empty text has no words and the fingerprint zero; it is linked like any
other. A null id never becomes the id of a group; a group of null ids alone has a null id. Repeated
rows have the same fingerprint and group. An empty table has no groups. Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.llm.components import components
from verbena.llm.support import ship, spare, text_of
from verbena.session import written

SEED = 42
SHINGLE = 3
BITS = 3  # most differing bits of a link
HALF = 32
CHECKS = 5  # parity checks of the code on 31 bits


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The majority bits of the XXH64 values of a text's shingles, as a signed number."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and white space of one byte
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False)))
    n = len(shingles)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, 64)
    # Sums of up to 255 rows fit a byte.
    blocks = np.add.reduceat(bits, np.arange(0, n, 255), axis=0, dtype=np.uint8)
    ones = blocks.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    """The 64-bit fingerprint of each text, as a long."""

    @F.arrow_udf("bigint")
    def values(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), size) for x in texts], pa.int64())

    return values(text.cast("binary"))


def flips() -> list[list[int]]:
    """By syndrome, what to flip in a half to get to each anchor within two bits of it.

    The first entry leads home. A syndrome is the exclusive or of the places (1 to 31) of the set
    bits; flipping bits whose places give the syndrome leads to a word of the code.
    """
    free = 1 << 31
    out = [[0, free]]
    for s in range(1, 32):
        one = 1 << (s - 1)
        pairs = [
            (1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < (i ^ s)
        ]
        out.append([one, one | free, *pairs])
    return out


def syndrome(half: Column) -> Column:
    """The exclusive or of the places of the set bits among the first 31."""
    total = F.lit(0)
    for check in range(CHECKS):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> check & 1)
        total = total + F.pmod(F.bit_count(half.bitwiseAND(F.lit(mask))), F.lit(2)) * (1 << check)
    return total


def anchored(nodes: DataFrame, fingerprint: str) -> DataFrame:
    """``half, anchor, home`` and the fingerprint, for each anchor that a half of it visits."""
    mask = F.lit((1 << HALF) - 1)
    halves = F.array(
        F.col(fingerprint).bitwiseAND(mask),
        F.shiftrightunsigned(F.col(fingerprint), HALF).bitwiseAND(mask),
    )
    rows = nodes.select(fingerprint, F.posexplode(halves).alias("half", "value"))
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in flips()])
    visits = rows.select(
        fingerprint, "half", "value", F.posexplode(F.get(table, syndrome(F.col("value")))).alias("k", "flip")
    )
    return visits.select(
        fingerprint,
        # One key for both halves: the anchor has 32 bits.
        (F.col("value").bitwiseXOR(F.col("flip")) * 2 + F.col("half")).alias("anchor"),
        (F.col("k") == 0).alias("home"),
    )


def near_pairs(nodes: DataFrame, fingerprint: str = "fp", bits: int = BITS) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints that differ in at most ``bits`` (3 or fewer) bits."""
    if not 0 < bits <= BITS:
        raise ValueError(f"two halves cover 1 to {BITS} differing bits")
    visits = anchored(nodes, fingerprint)
    here = visits.filter("home").select("anchor", F.col(fingerprint).alias("a"))
    there = visits.select("anchor", F.col(fingerprint).alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = (F.col("a") != F.col("b")) & (differing <= bits)
    # The visits are many times the table they come from, by whose size the planner would judge them.
    pairs = here.join(there.hint("merge"), (here["anchor"] == there["anchor"]) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = SHINGLE,
    bits: int = BITS,
) -> DataFrame:
    """``doc_id, row_hash, fp, component_id`` of every document.

    ``component_id`` is the least id that links lead to, ``row_hash`` a hash of the whole row.
    """
    ship(docs.sparkSession)
    marked = written(
        docs.select(
            F.col(key).alias("doc_id"),
            row_hash(docs).alias("row_hash"),
            fingerprints(text_of(text), size).alias("fp"),
        ),
        "fingerprints",
    )
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return grouped(marked, nodes, near_pairs(nodes, bits=bits))


def grouped(marked: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, row_hash, fp, component_id`` of ``marked`` (doc_id, row_hash, fp).

    ``nodes``: fp and the least id of its documents. ``links``: a, b, both an fp.
    """
    roots = components(links)
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "row_hash", "fp", "component_id")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document with the least id of each group, in the columns it came with.

    A null id counts as larger than any other; of equal rows one stays.
    """
    return kept_rows(docs, near_groups(docs, text, key), key)


def kept_rows(docs: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The row with the least id of each of the ``groups`` (doc_id, row_hash, fp, component_id)."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    # A group is its component; a group of null ids alone is its fingerprints.
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    first = groups.groupBy("component_id", group.alias("fp")).agg(F.min(rank).alias("first"))
    hashed = spare(docs, "row_hash")
    rows = docs.withColumn(hashed, row_hash(docs))
    kept = first.select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.row_hash").alias("kept_hash")
    )
    same = rows[key].eqNullSafe(kept["kept_id"]) & (rows[hashed] == kept["kept_hash"])
    left = rows.join(kept, same, "left_semi")
    return left.dropDuplicates([key, hashed]).drop(hashed)
