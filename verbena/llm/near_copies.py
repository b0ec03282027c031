"""Near copies by SimHash anchors, and by the exact Jaccard similarity of five-word shingles.

Each text is the set of the XXH64 values of its shingles; texts with equal sets are one node. Nodes first
meet by the fingerprints of :mod:`verbena.llm.simhash`: texts whose fingerprints differ in at most three
bits are found by its anchors and are one of its groups, and each node is compared with the first of its
group. What this joins needs no other comparison. Edited copies differ in more bits, so the similarity
decides which groups hold and finds the rest.

Further nodes that may have a near copy come from ``BANDS`` keys a node, each over ``WIDTH`` min-hashes: two sets of similarity
0.8 have none of the keys in common once in two million times (by calculation), more similar ones less
often. A pair is linked if the Jaccard similarity of its sets, counted in full, reaches the least one
asked for.

Which of these nodes to compare is settled by prefixes, without loss: a node's shingles stand in order of
how many of the nodes hold them, rare ones first, and two similar sets share one of the first shingles
of both. Where they meet first bounds what they can have in common behind it, so a text with many words of
its own, which only it holds, meets nobody. Nodes at a shingle are first compared with its hub, the node
that has it earliest and so has the fewest rare shingles, such as the text that others are copied from.
What these links join needs no other comparison; shingles whose nodes are not all joined take the next
``HUBS`` hubs in turn, and the few nodes left are compared in pairs. Links become groups by
:func:`verbena.llm.components.components`.

Defined cases. A null or empty text has no shingles and is a copy of other such texts alone. A text
of fewer words than a shingle is one shingle. Case of A-Z and kinds of white space don't count.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.llm.components import components
from verbena.llm.simhash import fingerprints, grouped, kept_rows, near_pairs, row_hash
from verbena.llm.support import ship, text_of
from verbena.operators.joins import lookup
from verbena.session import written

SEED = 42
SHINGLE = 5
LEAST = 0.8  # least similarity of a link
BANDS = 48
WIDTH = 6  # min-hashes of a key
BLOCK = 256  # shingles hashed at a time
HUBS = 3  # rounds of comparing with one node of each shingle


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, sorted."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))


def keys(values: np.ndarray) -> list[int]:
    """The keys of a set of shingles; none for the empty set."""
    import xxhash

    if not len(values):
        return []
    draws = np.random.default_rng(SEED).integers(0, 2**32, (2, BANDS * WIDTH), np.uint32)
    factor, term = draws[0] | 1, draws[1]
    small = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * WIDTH, 2**32 - 1, np.uint32)
    for at in range(0, len(small), BLOCK):
        np.minimum(least, (small[at : at + BLOCK, None] * factor + term).min(axis=0), out=least)
    bands = least.reshape(BANDS, WIDTH)
    hashed = [xxhash.xxh64_intdigest(row.tobytes(), seed) for seed, row in enumerate(bands)]
    return np.array(hashed, np.uint64).view(np.int64).tolist()


def marks(text: Column, size: int) -> Column:
    """``fp`` (a hash of the set of shingles) and ``keys`` of each text."""

    @F.arrow_udf("struct<fp:bigint,keys:array<bigint>>")
    def values(texts: pa.Array) -> pa.Array:
        import xxhash

        sets = [shingles(x.as_py(), size) for x in texts]
        prints = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
        return pa.StructArray.from_arrays(
            [
                pa.array(prints.view(np.int64), pa.int64()),
                pa.array([keys(s) for s in sets], pa.list_(pa.int64())),
            ],
            ["fp", "keys"],
        )

    return values(text.cast("binary"))


def shingle_sets(text: Column, size: int) -> Column:
    """The distinct hashes of each text's shingles, as longs."""

    @F.arrow_udf("array<bigint>")
    def values(texts: pa.Array) -> pa.Array:
        sets = [shingles(x.as_py(), size).view(np.int64) for x in texts]
        return pa.array(sets, pa.list_(pa.int64()))

    return values(text.cast("binary"))


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets (fp, own) are similar enough."""
    left = sets.select(F.col("fp").alias("a"), F.col("own").alias("left"))
    right = sets.select(F.col("fp").alias("b"), F.col("own").alias("right"))
    # The sets are many times the pairs; neither may be broadcast.
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    every = F.size("left") + F.size("right") - shared
    return both.filter(shared / every >= least).select("a", "b")


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def may_reach(least: float) -> Column:
    """Whether two sets can be similar, by their sizes and the places where they meet first."""
    total = F.col("size") + F.col("other_size")
    common = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    smaller, larger = F.least("size", "other_size"), F.greatest("size", "other_size")
    enough = common * (1 + least) >= least * total - 1e-6
    return enough & (smaller >= least * larger - 1e-6)


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``shingle, fp, place, size`` of the shingles where a similar set can be met.

    Shingles stand by how many sets hold them, then by their own value; a shingle of one set is
    counted in the places but is no row.
    """
    tokens = sets.select("fp", F.size("own").alias("size"), F.explode("own").alias("shingle"))
    held = tokens.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    met = tokens.join(held, "shingle")
    ordered = F.sort_array(F.collect_list(F.struct("held", "shingle")))
    rows = met.groupBy("fp", "size").agg(ordered.alias("met"))
    alone = F.col("size") - F.size("met")
    last = F.col("size") - F.ceil(least * F.col("size") - 1e-6) + 1
    first = F.slice("met", F.lit(1), F.greatest(last - alone, F.lit(0)).cast("int"))
    met_first = F.posexplode("first").alias("at", "meeting")
    placed = rows.withColumn("first", first).select("fp", "size", alone.alias("alone"), met_first)
    return placed.select(
        F.col("meeting.shingle").alias("shingle"),
        "fp",
        (F.col("alone") + F.col("at")).alias("place"),
        "size",
    )


def rooted(entries: DataFrame, links: DataFrame | None) -> DataFrame:
    """The entries at shingles whose nodes no link has joined yet, with the node's root."""
    if links is None:
        named = entries.withColumn("root", F.col("fp"))
    else:
        roots = components(links).withColumnRenamed("node", "fp")
        named = entries.drop("root").join(roots, "fp", "left")
        named = named.withColumn("root", F.coalesce("root", "fp"))
    ends = named.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = ends.filter("low <> high").select("shingle")
    return written(named.join(open_, "shingle"), "entries")


def met_pairs(here: DataFrame, there: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes of both tables at a shingle that can be similar."""
    other = there.select(
        "shingle", *[F.col(c).alias(f"other_{c}") for c in ("fp", "place", "size", "root")]
    )
    both = here.join(other.hint("merge"), "shingle").filter("root <> other_root")
    return both.filter(may_reach(least)).select(*pair("fp", "other_fp")).distinct()


def print_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node and the first of its group, by ``prints``: fp and a fingerprint of its texts.

    A group holds the fingerprints that links of at most three bits lead to, as those of ``op1`` do.
    """
    links = near_pairs(prints.select("print").distinct(), "print")
    roots = components(links).withColumnRenamed("node", "print")
    named = prints.join(roots, "print", "left").select("fp", F.coalesce("root", "print").alias("root"))
    named = written(named.distinct(), "groups")
    hubs = named.groupBy("root").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).filter("hub <> last")
    # Groups of one node have no hub; the rows of a large group do not meet in one task.
    met = lookup(named, written(hubs.select("root", "hub"), "hubs"), ["root"], ["fp"]).filter("fp <> hub")
    return met.select(*pair("fp", "hub")).distinct()


def similar_pairs(sets: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """Links that join what the pairs of similar sets (fp, own) join; the pairs ``asked`` come first."""
    links, done = None if asked is None else written(similar(asked, sets, least), "near"), asked
    entries = rooted(written(prefixes(sets, least), "prefixes"), links)
    columns = F.struct("place", "size", "fp", "root")
    for turn in range(HUBS + 1):
        if turn < HUBS:
            # The hub leaves its shingle: it has been compared with all others there.
            hubs = entries.groupBy("shingle").agg(F.min(columns).alias("hub"))
            hubs = written(hubs.select("shingle", "hub.*"), "hubs")
            asked = met_pairs(entries, hubs, least)
        else:
            asked = met_pairs(entries, entries.filter("true"), least)
        if done is not None:
            asked = asked.join(done, ["a", "b"], "left_anti")
        asked = written(asked, "pairs")
        found = written(similar(asked, sets, least), "near")
        links = found if links is None else links.unionByName(found)
        done = asked if done is None else done.unionByName(asked)
        if turn < HUBS:
            left = entries.join(hubs.select("shingle", "fp"), ["shingle", "fp"], "left_anti")
            entries = rooted(left, links)
    return links


def near_groups(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = SHINGLE,
    least: float = LEAST,
) -> DataFrame:
    """``doc_id, row_hash, fp, component_id`` of every document; ``least`` is 0.8 or more.

    ``component_id`` is the least id that links lead to, ``row_hash`` a hash of the whole row.
    """
    if not LEAST <= least <= 1:
        raise ValueError(f"the keys cover similarities from {LEAST}")
    ship(docs.sparkSession)
    value = marks(text_of(text), size)
    marked = docs.select(
        F.col(key).alias("doc_id"),
        row_hash(docs).alias("row_hash"),
        value.alias("marks"),
        fingerprints(text_of(text)).alias("print"),
    ).select("doc_id", "row_hash", "marks.*", "print")
    marked = written(marked, "shingles")
    first = written(print_pairs(written(marked.select("fp", "print").distinct(), "prints")), "print_pairs")
    # One row of each node stands for it.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    nodes = written(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(rank).alias("row")), "nodes"
    )
    once = marked.groupBy("fp").agg(F.first("keys").alias("keys"))
    visits = written(once.select("fp", F.explode("keys").alias("key")).distinct(), "keys")
    ends = visits.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    shared = visits.join(ends.filter("low <> high").select("key"), "key")
    ends = first.select(F.explode(F.array("a", "b")).alias("fp"))
    asked = nodes.join(shared.select("fp").union(ends).distinct(), "fp").select(
        "fp", F.col("row.doc_id").alias("row_id"), F.col("row.row_hash").alias("hash")
    )
    rows = docs.select(
        F.col(key).alias("id"), row_hash(docs).alias("own"), text_of(text).alias("value")
    )
    found = rows.join(asked, F.col("id").eqNullSafe(F.col("row_id")) & (F.col("own") == F.col("hash")))
    texts = found.select("fp", "value").dropDuplicates(["fp"])
    sets = written(texts.select("fp", shingle_sets(F.col("value"), size).alias("own")), "sets")
    return grouped(marked.drop("keys", "print"), nodes, similar_pairs(sets, least, first))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document with the least id of each group, in the columns it came with."""
    return kept_rows(docs, near_groups(docs, text, key), key)
