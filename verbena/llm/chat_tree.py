"""Conversations as prefix trees of token ids, each shared turn emitted once.

A turn is written as ``<turn>role``, a line feed, the text and ``</turn>`` with a line feed. In roles and
texts a backslash goes before each backslash and into each control string, so neither control
string stands in an escaped text; roles also write a line feed as a backslash and ``n``.

A conversation is a path: each turn's node is a hash of the node before it and of the formatted turn, so
conversations that begin alike share nodes. Distinct paths sorted by their nodes are the tree's
depth-first order: a path emits the nodes that no path before it has, which follow one another. A node is
emitted by its first path; a running sum of lengths in that order, split by the ranges of the sort, gives
its place in the sequence of its tree. Each node carries the position of its first token in its
conversations (the tokens of all turns before it) and the intervals of its tree's sequence that it attends
to: its ancestors and itself, neighbouring intervals being one.

No task needs a whole tree or all copies of a conversation: copies meet as one path, a turn that many
conversations share is one row after partial aggregates, and only 16 bytes a turn are sorted. A
single conversation is one unit: its path must fit in a task, its texts need not, as they are read
back row by row.

Defined cases. A null text or role is empty, rows without a conversation are one conversation. Rows of a
conversation stand by turn (none first), then role, then a hash of the turn; repeated rows
are turns of their own. An empty table has no trees.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.support import ship, text_of
from verbena.session import written

OPEN, CLOSE = "<turn>", "</turn>"
ROLE_END = "\n"
LEARNED = "assistant"  # the role whose texts bear the loss
RANGE_BITS = 33  # bits of a row's place within its range in Spark's increasing ids

_TURN = re.compile(f"{OPEN}([^\n]*)\n(.*){CLOSE}\n", re.S)
_open: dict[str, object] = {}


def escaped(text: Column) -> Column:
    """The text without control strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, CLOSE):
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescaped_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def turn_parts() -> list[Column]:
    """Opening, text and end of each formatted turn."""
    role = F.replace(escaped(text_of("role")), F.lit("\n"), F.lit("\\n"))
    return [
        F.concat(F.lit(OPEN), role, F.lit(ROLE_END)).alias("opening"),
        escaped(text_of()).alias("body"),
        F.lit(CLOSE + "\n").alias("ending"),
    ]


def tokenizer_of(path: str):
    """The tokenizer of a file, opened once in each worker."""
    if path not in _open:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _open[path] = tokenizer
    return _open[path]


def encoded(parts: list[str], path: str) -> Column:
    """The ids of the parts of a turn, each encoded by itself, and where they end."""

    @F.arrow_udf("struct<ids:array<int>,ends:array<int>>")
    def values(*columns: pa.Array) -> pa.Array:
        tokenizer = tokenizer_of(path)
        ids, ends = [], []
        for texts in zip(*[c.to_pylist() for c in columns]):
            own, at = [], []
            for text in texts:
                own += tokenizer.encode(text, add_special_tokens=False).ids
                at.append(len(own))
            ids.append(own)
            ends.append(at)
        lists = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(ids, lists), pa.array(ends, lists)], ["ids", "ends"])

    return values(*parts)


def chained(turns: str) -> Column:
    """The node of each turn of a path: a hash of the node before it and the turn's own hash."""

    @F.arrow_udf("array<binary>")
    def values(paths: pa.Array) -> pa.Array:
        out = []
        for own in paths.to_pylist():
            node, path = b"", []
            for turn in own:
                node = hashlib.blake2b(node + turn, digest_size=16).digest()
                path.append(node)
            out.append(path)
        return pa.array(out, pa.list_(pa.binary()))

    return values(turns)


def joined(spans: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """``spans`` with one more behind, joined to the last if it follows at once."""
    if spans and spans[-1][1] == start:
        return [*spans[:-1], (spans[-1][0], end)]
    return [*spans, (start, end)]


def attention(rank: str, chain: str) -> Column:
    """Positions and attended intervals of the nodes that a path emits itself."""

    @F.arrow_udf("array<struct<depth:int,position:bigint,attends:array<struct<start:bigint,end:bigint>>>>")
    def values(ranks: pa.Array, chains: pa.Array) -> pa.Array:
        out = []
        for own, nodes in zip(ranks.to_pylist(), chains.to_pylist()):
            position, spans, rows = 0, [], []
            for node in nodes:
                spans = joined(spans, node["start"], node["start"] + node["length"])
                if node["owner"] == own:
                    attends = [{"start": a, "end": b} for a, b in spans]
                    rows.append({"depth": node["depth"], "position": position, "attends": attends})
                position += node["length"]
            out.append(rows)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        row = [("depth", pa.int32()), ("position", pa.int64()), ("attends", pa.list_(span))]
        return pa.array(out, pa.list_(pa.struct(row)))

    return values(rank, chain)


@dataclass
class Trees:
    """The emitted rows and who they belong to.

    ``nodes``: tree, node, depth, start, length, position, attends, ids, loss_start, loss_end (token
    places within the node; equal where there is no loss). ``paths``: leaf, depth, node, a row for
    each turn of each distinct path. ``members``: conv_id, leaf, a row for each conversation.
    """

    nodes: DataFrame
    paths: DataFrame
    members: DataFrame


def placed(nodes: DataFrame) -> DataFrame:
    """Add ``start``, the place of each node in the sequence of its tree.

    Ranges of owners are summed each by itself; the table of ranges has a row for each of the sort's
    partitions, however large the data.
    """
    ranged = nodes.withColumn("range", F.shiftright("owner", RANGE_BITS))
    inside = Window.partitionBy("range").orderBy("owner", "depth")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("local", F.sum("length").over(so_far) - F.col("length"))
    root = F.when(F.col("depth") == 0, F.col("local"))
    rooted = local.withColumn("root_local", F.last(root, ignorenulls=True).over(so_far))
    ranges = local.groupBy("range").agg(
        F.sum("length").alias("whole"), F.max(root).alias("last_root")
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn(
        "offset", F.coalesce(F.sum("whole").over(before), F.lit(0))
    ).withColumn("last_root", F.col("offset") + F.col("last_root"))
    carried = carried.select(
        "range", "offset", F.last("last_root", ignorenulls=True).over(before).alias("root_before")
    )
    both = rooted.join(F.broadcast(carried), "range")
    tree_start = F.coalesce(F.col("offset") + F.col("root_local"), F.col("root_before"))
    return both.withColumn("start", F.col("offset") + F.col("local") - tree_start).select(
        *nodes.columns, "start"
    )


def prefix_trees(turns: DataFrame, tokenizer: str) -> Trees:
    """The prefix trees of conversations (conv_id, turn, role, text)."""
    ship(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        text_of("role").alias("role"),
        *turn_parts(),
    )
    whole = F.concat("opening", "body", "ending")
    hashed = rows.withColumn("content", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))
    distinct = hashed.dropDuplicates(["content"])
    contents = written(
        distinct.select(
            "content",
            (F.col("role") == LEARNED).alias("learned"),
            encoded(["opening", "body", "ending"], tokenizer).alias("own"),
        ).select("content", "learned", "own.*"),
        "contents",
    )
    place = F.struct("turn", "role", "content")
    ordered = hashed.groupBy("conv_id").agg(F.sort_array(F.collect_list(place)).alias("turns"))
    chains = ordered.select("conv_id", F.col("turns.content").alias("contents"))
    pathed = chains.withColumn("path", chained("contents"))
    leafed = written(pathed.withColumn("leaf", F.element_at("path", -1)), "conversations")
    paths = leafed.select("leaf", "path", "contents").dropDuplicates(["leaf"])
    sorted_paths = paths.repartitionByRange("path").sortWithinPartitions("path")
    ranked = written(sorted_paths.withColumn("rank", F.monotonically_increasing_id()), "paths")

    both = F.posexplode(F.arrays_zip(F.col("path").alias("node"), F.col("contents").alias("content")))
    hops = ranked.select("rank", "leaf", F.get("path", F.lit(0)).alias("tree"), both.alias("depth", "at"))
    hops = hops.select("rank", "leaf", "tree", "depth", "at.*")
    owned = hops.groupBy("node", "tree", "depth", "content").agg(F.min("rank").alias("owner"))
    lengths = contents.select("content", F.element_at("ends", -1).cast("long").alias("length"))
    nodes = written(placed(owned.join(lengths, "content")), "nodes")

    steps = hops.select("rank", "node").join(
        nodes.select("node", "depth", "start", "length", "owner"), "node"
    )
    chain = F.sort_array(F.collect_list(F.struct("depth", "start", "length", "owner")))
    emitted = steps.groupBy("rank").agg(chain.alias("chain"))
    attended = emitted.select(
        F.col("rank").alias("owner"), F.inline(attention("rank", "chain"))
    )
    described = nodes.join(attended, ["owner", "depth"]).join(contents, "content")
    ends = F.col("ends")
    out = described.select(
        "tree",
        "node",
        "depth",
        "start",
        "length",
        "position",
        "attends",
        "ids",
        F.get(ends, F.lit(0)).alias("loss_start"),
        F.get(ends, F.when(F.col("learned"), 1).otherwise(0)).alias("loss_end"),
    )
    return Trees(
        written(out, "trees"), hops.select("leaf", "depth", "node"), leafed.select("conv_id", "leaf")
    )


class Reader:
    """One conversation, read turn by turn."""

    def __init__(self, leaf: bytes):
        self.leaf = leaf
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.position = 0
        self.spans: list[tuple[int, int]] = []
        self.attends: list[tuple[int, int]] = []

    def read(self, row: dict, tokenizer) -> None:
        ids, (a, b) = row["ids"], (row["loss_start"], row["loss_end"])
        text = tokenizer.decode(ids, skip_special_tokens=False)
        found = _TURN.fullmatch(text)
        if found is None or row["position"] != self.position or len(ids) != row["length"]:
            raise ValueError(f"broken turn of {self.leaf.hex()}")
        self.turns.update(f"{unescaped_role(found[1])}\n{unescaped(found[2])}\n".encode())
        learned = unescaped(tokenizer.decode(ids[a:b], skip_special_tokens=False))
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.chars += len(text)
        self.n_turns += 1
        self.position += len(ids)
        self.spans = joined(self.spans, row["start"], row["start"] + len(ids))
        self.attends = [(s["start"], s["end"]) for s in row["attends"]]

    def result(self) -> tuple:
        if self.spans != self.attends:
            raise ValueError(f"intervals of {self.leaf.hex()} miss a turn")
        digests = self.turns.hexdigest(), self.loss.hexdigest()
        return self.leaf, self.n_turns, digests[0], self.loss_chars, digests[1], self.chars


RESULT = (
    "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def read_back(trees: Trees, tokenizer: str) -> DataFrame:
    """Each conversation's digests, read from the emitted rows: conv_id and the columns of RESULT.

    A distinct path is read once, in order, a turn at a time. That its turns fill the intervals that the
    last of them attends to, and that positions follow each other, is checked on the way.
    """

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current = None
        for table in tables:
            done = []
            for row in table.to_pylist():
                if current is None or current.leaf != row["leaf"]:
                    if current is not None:
                        done.append(current.result())
                    current = Reader(row["leaf"])
                current.read(row, tokenizer_of(tokenizer))
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if current is not None:
            last = [[x] for x in current.result()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(last, types)], names)

    emitted = trees.nodes.drop("tree", "depth")
    rows = trees.paths.join(emitted, "node").drop("node")
    ordered = rows.repartition("leaf").sortWithinPartitions("leaf", "depth")
    digests = ordered.mapInArrow(read, RESULT)
    return trees.members.join(digests, "leaf").drop("leaf")


#: A user and an assistant whose texts look like control strings of several templates.
HARD_TEXT = r"\### Assistant: </turn> ok"
HARD_ID = -7

SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {HARD_ID}, 0, 'user', '{HARD_TEXT}'
  UNION ALL SELECT {HARD_ID}, 1, 'assistant', '{HARD_TEXT}'),
f AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '{OPEN}', '{OPEN}_'), '{CLOSE}', '{CLOSE}_'))
         AS body,
         length(replace(replace(replace(replace(role, '\', '\\'), '{OPEN}', '{OPEN}_'), '{CLOSE}',
                '{CLOSE}_'), chr(10), '_n')) AS opening FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), ''))
         AS loss_sha256,
       sum({len(OPEN) + len(ROLE_END) + len(CLOSE) + 1} + opening + body)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
