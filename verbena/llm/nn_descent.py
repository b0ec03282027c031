"""Approximate nearest neighbours by NN-descent and greedy graph search.

The index is a graph: for every distinct vector its ``K`` nearest found so far. It starts from
blocks of vectors that agree on the signs of a few random projections. Each round of NN-descent
joins every node's neighbours (and a bounded number of the nodes that name it) with their vectors,
compares those neighbours with each other, and keeps what improves a list. Vectors travel as bytes
of 8 bits a component, at each vector's own scale, in these rounds, which go on until few lists change;
scores that are returned are always of the original vectors.

A search keeps the ``WIDE`` best nodes a query has met and, hop by hop, looks up the neighbours of
its best nodes that were not opened yet, until none is left. A node's neighbours are one row with their
8-bit points, so a hop moves queries to the nodes they open and back only what is among the best; the
best in the end are scored anew by the original vectors. Queries start at themselves, as they
are part of the index, and at the vectors of largest norm; nearness is the inner product. Vectors of unequal norms are given one more
component for building the graph that makes their norms equal, which turns the largest inner
product with a query into the smallest distance.

Copies of a vector are one node with its smallest ids, so a group of copies of any size costs one
node. Blocks, lists and what a node compares are all of bounded size.

Defined cases. Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without an id. Vectors of several lengths have no product: each length is searched by
itself. Equal rows count once. An empty table has no neighbours. Ties go to the
smaller id. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.support import ship
from verbena.session import written

K = 32  # neighbours kept for a node
REVERSE = 32  # nodes that name it, at most, in a comparison
TABLES = 8  # sets of projections for the first graph
FIRST = 16  # neighbours that a block of the first graph gives a node
BLOCK = 128  # vectors compared with each other in the first graph
SETTLED = 0.01  # the share of new neighbours in a round below which the graph is done
LONGEST = 1 << 14  # rows of one key of the first graph that are held at a time
TALL = 32  # nodes of largest norm that every query meets
WIDE = 256  # best nodes kept in a search
STEP = 64  # nodes opened in a hop
NEAREST = 20
SEED = 17

EDGES = "u bigint, v bigint, near double"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part, equal rows once."""
    values = F.col(vector).cast("array<double>")
    finite = F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    some = F.exists(values, lambda x: x != 0)
    return (
        rows.select(F.col(key).cast("long").alias("id"), values.alias("vector"))
        .filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
        .filter(finite & some)
        .distinct()
    )


def packed(column: str):
    """Vectors of one length as bytes of 64-bit floats."""

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())

    return pack(F.col(column))


def levelled(column: str, centre: list[float], square: float):
    """Vectors as points for the graph: 8 bits a component, and each vector's own scale as a 32-bit float.

    With a further component ``sqrt(square - |v|**2)`` all norms would be equal, and the largest inner
    product the least distance. Distances are kept if points are moved, so that component is put as its
    difference from ``sqrt(square)``, which stays exact beside one vector of huge norm, and the middle is
    taken off the others.
    """
    middle = np.array(centre, np.float64)

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        own = np.einsum("nd,nd->n", x, x)
        more = own / (np.sqrt(square) + np.sqrt(np.maximum(0.0, square - own)))
        points = np.hstack([x - middle, more[:, None]])
        scale = np.maximum(np.abs(points).max(axis=1) / 127, 1e-30).astype("<f4")
        bits = np.clip(np.rint(points / scale[:, None]), -127, 127).astype(np.int8)
        both = np.hstack([bits.view(np.uint8), scale[:, None].view(np.uint8)])
        return pa.array([row.tobytes() for row in both], pa.binary())

    return pack(F.col(column))


def points_of(column: pa.Array) -> np.ndarray:
    """The points that ``levelled`` packed, to 8 bits of each one's scale."""
    raw = unpacked(column, np.uint8)
    scale = np.ascontiguousarray(raw[:, -4:]).view("<f4")
    return np.ascontiguousarray(raw[:, :-4]).view(np.int8).astype(np.float32) * scale


def nearness(x: np.ndarray) -> np.ndarray:
    """Half the squared distance of each two points, negative; a point is not near itself."""
    half = np.einsum("nd,nd->n", x, x) / 2
    near = x @ x.T - half[:, None] - half[None, :]
    np.fill_diagonal(near, -np.inf)
    return near


def unpacked(column: pa.Array, kind) -> np.ndarray:
    """A matrix from a column of equally long bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def runs(
    batches: Iterator[pa.RecordBatch], most: int | None = None
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables with whole runs of equal first columns, and where the runs begin (and end).

    With ``most``, a run longer than that is given out in parts, so that it is never held whole.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = table.column(0).to_numpy()
        if not len(keys):
            continue
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        last = int(starts[-1])
        if most and len(table) - last > most:
            yield table, np.append(starts, len(table))
            rest = None
            continue
        if last:
            yield table.slice(0, last).combine_chunks(), starts
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.array([0, len(rest)])


def first_graph(nodes: DataFrame, total: int, dims: int) -> DataFrame:
    """Edges inside blocks of nodes on the same side of random planes."""
    bits = max(0, int(np.ceil(np.log2(max(1, total / BLOCK)))))
    planes = np.random.default_rng(SEED).normal(size=(TABLES, bits + 1, dims))

    @F.arrow_udf("array<struct<key:bigint,at:double>>")
    def sides(vectors: pa.Array) -> pa.Array:
        x = points_of(vectors).astype(np.float64)
        out = np.einsum("tbd,nd->ntb", planes, x)
        keys = ((out[:, :, :bits] > 0) << np.arange(bits)).sum(axis=2) * TABLES + np.arange(TABLES)
        rows = [
            [{"key": int(k), "at": float(a)} for k, a in zip(ks, at, strict=True)]
            for ks, at in zip(keys, out[:, :, bits], strict=True)
        ]
        return pa.array(rows, pa.list_(pa.struct([("key", pa.int64()), ("at", pa.float64())])))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, LONGEST):
            ids = table.column("node").to_numpy()
            x = points_of(table.column("small"))
            out_u, out_v, out_near = [], [], []
            ends = [*starts[1:], len(ids)] if starts[-1] != len(ids) else starts[1:]
            for start, end in zip(starts, ends, strict=False):
                for a in range(start, end, BLOCK):
                    # Blocks overlap by half, so that neighbours along the line meet.
                    b = min(end, a + BLOCK + BLOCK // 2)
                    near = nearness(x[a:b])
                    k = min(FIRST, b - a - 1)
                    if k < 1:
                        continue
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    out_u.append(np.repeat(ids[a:b], k))
                    out_v.append(ids[a:b][best].reshape(-1))
                    out_near.append(np.take_along_axis(near, best, 1).reshape(-1))
            if out_u:
                yield edge_batch(out_u, out_v, out_near)

    dealt = nodes.select("node", "small", F.explode(sides("small")).alias("s")).select(
        F.col("s.key").alias("key"), F.col("s.at").alias("at"), "node", "small"
    )
    # By ranges, so a key that most vectors share is split along its line.
    ranged = dealt.repartitionByRange("key", "at", "node").sortWithinPartitions("key", "at", "node")
    return ranged.mapInArrow(compare, EDGES)


def edge_batch(u: list, v: list, near: list) -> pa.RecordBatch:
    """The ``K`` nearest that a batch found for each of its nodes, each once."""
    u, v, near = np.concatenate(u), np.concatenate(v), np.concatenate(near).astype(np.float64)
    order = np.lexsort((-near, v, u))
    u, v, near = u[order], v[order], near[order]
    first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    u, v, near = u[first], v[first], near[first]
    order = np.lexsort((v, -near, u))
    u, v, near = u[order], v[order], near[order]
    starts = np.flatnonzero(np.append(True, u[1:] != u[:-1])[: len(u)])
    places = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
    kept = places < K
    return pa.RecordBatch.from_arrays(
        [pa.array(u[kept], pa.int64()), pa.array(v[kept], pa.int64()), pa.array(near[kept])],
        ["u", "v", "near"],
    )


def nearest_of(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node, each once, with their rank and whether they were ``old``."""
    order = Window.partitionBy("u").orderBy(F.desc("near"), "v")
    once = (
        edges.repartition("u")
        .groupBy("u", "v")
        .agg(F.max("near").alias("near"), F.max("old").alias("old"))
    )
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def both_ways(graph: DataFrame) -> DataFrame:
    """Neighbours of a node, and a bounded number of the nodes that name it: ``u, v, old``.

    Two that name each other are there twice.
    """
    order = Window.partitionBy("v").orderBy(F.desc("near"), F.xxhash64("u"))
    back = (
        graph.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= REVERSE)
        .select(F.col("v").alias("u"), F.col("u").alias("v"), "old")
    )
    return graph.select("u", "v", "old").unionByName(back)


def descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round: what neighbours of a node are to each other, if it improves a list.

    Two neighbours that were both there in the round before have met and are not compared again.
    """
    worst = graph.groupBy("u").agg(
        F.when(F.count("*") >= K, F.min("near")).otherwise(F.lit(float("-inf"))).alias("worst")
    )
    members = nodes.select(F.col("node").alias("v"), "small").join(
        worst.withColumnRenamed("u", "v"), "v", "left"
    )
    met = both_ways(graph).join(members, "v").select("u", "v", "small", "worst", "old")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches):
            ids = table.column("v").to_numpy()
            x = points_of(table.column("small"))
            worst = np.nan_to_num(table.column("worst").to_numpy(), nan=-np.inf)
            old = table.column("old").to_numpy()
            out_u, out_v, out_near = [], [], []
            ends = [*starts[1:], len(ids)] if starts[-1] != len(ids) else starts[1:]
            for a, b in zip(starts, ends, strict=False):
                # A neighbour in both ways counts once, and as new if either way is.
                order = a + np.lexsort((old[a:b], ids[a:b]))
                own = order[np.append(True, ids[order[1:]] != ids[order[:-1]])]
                near = nearness(x[own])
                met = old[own, None] & old[None, own]
                i, j = np.nonzero((near > worst[own, None]) & ~met)
                out_u.append(ids[own[i]])
                out_v.append(ids[own[j]])
                out_near.append(near[i, j])
            if out_u:
                yield edge_batch(out_u, out_v, out_near)

    found = met.repartition("u").sortWithinPartitions("u").mapInArrow(compare, EDGES)
    known = graph.select("u", "v", "near", F.lit(True).alias("old"))
    return nearest_of(known.unionByName(found.withColumn("old", F.lit(False))), K)


def build_graph(nodes: DataFrame, settled: float = SETTLED) -> DataFrame:
    """The neighbour graph ``u, v, near, rank, old`` of ``nodes`` (node, small).

    Rounds go on until one renews less than the share ``settled`` of all entries. Lists only get nearer, so
    that comes.
    """
    total = nodes.count()
    one = nodes.select("small").first()
    dims = len(one["small"]) - 4 if one else 1
    first = first_graph(nodes, total, dims).withColumn("old", F.lit(False))
    graph = written(nearest_of(first, K), "graph")
    while True:
        graph = written(descend(graph, nodes), "graph")
        count = graph.agg(F.count("*"), F.count_if(~F.col("old"))).first()
        if count[1] <= settled * count[0]:
            return graph


def neighbour_rows(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """``u, near_by``: a node's neighbours of both ways (at most ``K + REVERSE``) with their points."""
    pairs = both_ways(graph).select("u", "v").distinct()
    full = pairs.join(nodes.select(F.col("node").alias("v"), "small"), "v")
    return full.groupBy("u").agg(F.collect_list(F.struct("v", "small")).alias("near_by"))


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``query_id, node, score`` of the neighbours in rows of query_id, vector, least, near_by.

    Scores are products with the points, which are short of the real ones by the same for all nodes of a
    query. Those not above ``least`` are left out.
    """
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            near_by = part.column("near_by")
            sizes = np.diff(near_by.offsets.to_numpy())
            if not sizes.sum():
                continue
            each = near_by.flatten()
            points = points_of(each.field("small"))[:, :-1].astype(np.float64)
            row = np.repeat(np.arange(len(part)), sizes)
            vectors = unpacked(part.column("vector"), np.float64)
            scores = np.einsum("nd,nd->n", points, vectors[row])
            kept = scores > part.column("least").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.column("query_id").to_numpy()[row[kept]], pa.int64()),
                    pa.array(each.field("v").to_numpy()[kept], pa.int64()),
                    pa.array(scores[kept]),
                ],
                ["query_id", "node", "score"],
            )


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, tall: list) -> DataFrame:
    """The ``WIDE`` best nodes that each query meets: ``query_id, node, score``.

    ``queries``: query_id, start (a node), vector (bytes). ``nodes``: node, vector (bytes), small. ``tall``:
    further nodes (node, small), at most ``TALL``, at which each query starts.
    """
    links = written(neighbour_rows(graph, nodes), "links")
    asked = queries.select("query_id", "vector")

    def met(frontier: DataFrame) -> DataFrame:
        rows = frontier.join(asked, "query_id").select("query_id", "vector", "least", "near_by")
        return rows.mapInArrow(meet, "query_id bigint, node bigint, score double")

    def best_of(rows: DataFrame) -> DataFrame:
        """The best nodes of each query, each once, with those that the next hop opens."""
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
        turn = Window.partitionBy("query_id", "opened").orderBy(F.desc("score"), "node")
        whole = Window.partitionBy("query_id")
        once = (
            rows.repartition("query_id")
            .groupBy("query_id", "node")
            .agg(F.max("score").alias("score"), F.max("opened").alias("opened"))
        )
        kept = once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= WIDE)
        least = F.when(F.count("*").over(whole) >= WIDE, F.min("score").over(whole))
        return kept.select(
            "query_id",
            "node",
            "score",
            "opened",
            (~F.col("opened") & (F.row_number().over(turn) <= STEP)).alias("opens"),
            F.coalesce(least, F.lit(float("-inf"))).alias("least"),
        )

    further = [F.struct(F.lit(r["node"]).alias("v"), F.lit(bytes(r["small"])).alias("small")) for r in tall]
    own = nodes.select(F.col("node").alias("start"), F.struct(F.col("node").alias("v"), "small").alias("own"))
    starts = queries.join(own, "start").select(
        "query_id", F.lit(float("-inf")).alias("least"), F.array("own", *further).alias("near_by")
    )
    state = written(best_of(met(starts).withColumn("opened", F.lit(False))), "search")
    while not state.filter("opens").isEmpty():
        opening = state.filter("opens").select("query_id", F.col("node").alias("u"), "least")
        new = met(opening.join(links, "u")).withColumn("opened", F.lit(False))
        seen = state.select("query_id", "node", "score", (F.col("opened") | F.col("opens")).alias("opened"))
        state = written(best_of(seen.unionByName(new)), "search")

    @F.arrow_udf("double")
    def product(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = unpacked(left, np.float64), unpacked(right, np.float64)
        width = min(a.shape[1], b.shape[1]) if len(a) else 0
        return pa.array(np.einsum("nd,nd->n", a[:, :width], b[:, :width]), pa.float64())

    full = state.select("query_id", "node").join(nodes.select("node", F.col("vector").alias("own")), "node")
    return full.join(asked, "query_id").select("query_id", "node", product("vector", "own").alias("score"))


def nearest_neighbours(
    rows: DataFrame,
    is_query,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found of each row that is a query."""
    ship(rows.sparkSession)
    good = written(usable(rows, key, vector), "vectors")
    sizes = [r["n"] for r in good.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    parts = [of_one_length(good.filter(F.size("vector") == n), n, is_query, nearest) for n in sizes or [1]]
    return reduce(DataFrame.unionByName, parts)


def of_one_length(good: DataFrame, dims: int, is_query, nearest: int) -> DataFrame:
    """``nearest_neighbours`` among usable vectors of ``dims`` components."""
    # The smallest ids of each distinct vector; one more than asked for, as a query leaves itself out.
    order = Window.partitionBy("vector").orderBy("id")
    copies = good.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= nearest + 1)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    grouped = written(
        copies.groupBy("vector")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select("ids", "vector", F.xxhash64("vector").alias("node"), squares.alias("square")),
        "distinct",
    )
    means = [F.avg(F.get("vector", F.lit(k))) for k in range(dims)]
    top = grouped.agg(F.max("square"), *means).first()
    square, centre = top[0] or 1.0, [x or 0.0 for x in top[1:]]
    nodes = written(
        grouped.select(
            "node",
            "ids",
            "square",
            packed("vector").alias("vector"),
            levelled("vector", centre, square).alias("small"),
        ),
        "nodes",
    )
    graph = build_graph(nodes.select("node", "small"))
    tall = nodes.orderBy(F.desc("square"), "node").limit(TALL).select("node", "small").collect()
    asked = good.filter(is_query(F.col("id"))).select(
        F.col("id").alias("query_id"),
        F.xxhash64("vector").alias("start"),
        packed("vector").alias("vector"),
    )
    found = search(written(asked, "queries"), graph, nodes.select("node", "vector", "small"), tall)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.join(nodes.select("node", "ids"), "node")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
