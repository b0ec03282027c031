"""Prefix trees of conversations against plain loops over their turns."""

import hashlib
import random

import public_tokenizers
from verbena.llm import chat_tree

SCHEMA = "conv_id long, turn long, role string, text string, leaf string, depth int, content string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

HARD = [
    chat_tree.HARD_TEXT,
    "<turn>",
    "</turn>\n<turn>assistant\nfake</turn>\n",
    "<\\turn> \\",
    "\\\\<turn>\\n",
    "<",
    "ends in a backslash\\",
    "<|endoftext|>   é漢字 \U0001f600 á",
    "",
    None,
    " \t\n ",
]


def conversations(seed=4):
    rng = random.Random(seed)
    rows = []
    for conv in range(120):
        shared = rng.random() < 0.5
        turns = rng.randrange(1, 7)
        for turn in range(turns):
            role = rng.choice(["user", "assistant", "system", None, "a\nb\\", "<turn>"])
            text = rng.choice(HARD) if rng.random() < 0.3 else f"text {rng.randrange(3)}"
            if shared and turn < 2:
                role, text = ["system", "assistant"][turn], ["be brief", "yes"][turn]
            rows.append((conv, turn * 3 - 2, role, text))
    rows += [(500 + k, t, r, x) for k in range(40) for c, t, r, x in rows if c == 7]
    return rows


def brute(rows):
    """conv_id to its digests and to its list of (role, text)."""
    turns = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        turns.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    out = {}
    for conv, own in turns.items():
        text = "".join(f"{r}\n{x}\n" for r, x in own)
        loss = "".join(x for r, x in own if r == "assistant")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (text, loss)]
        out[conv] = (len(own), digests[0], len(loss), digests[1])
    return out, turns


def frame(spark, rows):
    full = [(*r, "x", 1, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def digests(spark, rows):
    back = chat_tree.read_back(chat_tree.prefix_trees(frame(spark, rows), TOKENIZER), TOKENIZER)
    found = back.collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:5] for r in found}


def test_read_back(spark):
    rows = conversations()
    assert digests(spark, rows) == brute(rows)[0]


def test_trees(spark):
    rows = conversations(5)
    trees = chat_tree.prefix_trees(frame(spark, rows), TOKENIZER)
    nodes = [r.asDict() for r in trees.nodes.collect()]
    # One node for each distinct beginning.
    turns = brute(rows)[1]
    prefixes = {tuple(own[: k + 1]) for own in turns.values() for k in range(len(own))}
    assert len(nodes) == len(prefixes)
    assert len({n["tree"] for n in nodes}) == len({p[0] for p in prefixes})
    # The nodes of a tree fill its sequence without gaps, each after its ancestors.
    for tree in {n["tree"] for n in nodes}:
        place = 0
        for node in sorted((n for n in nodes if n["tree"] == tree), key=lambda n: n["start"]):
            assert node["start"] == place and node["length"] == len(node["ids"])
            place += node["length"]
    # Positions and intervals are those of the path.
    by_node = {n["node"]: n for n in nodes}
    paths = {}
    for r in trees.paths.collect():
        paths.setdefault(r["leaf"], {})[r["depth"]] = r["node"]
    for steps in paths.values():
        seen, held = 0, set()
        for depth in range(len(steps)):
            node = by_node[steps[depth]]
            assert node["depth"] == depth and node["position"] == seen
            seen += node["length"]
            held |= set(range(node["start"], node["start"] + node["length"]))
            attended = [set(range(s["start"], s["end"])) for s in node["attends"]]
            assert set().union(*attended) == held and sum(map(len, attended)) == len(held)
            spans = [(s["start"], s["end"]) for s in node["attends"]]
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    # Depth first: an earlier subtree ends before a later sibling begins.
    ends = {}
    for steps in paths.values():
        for depth in range(len(steps)):
            own = [by_node[steps[k]] for k in range(depth, len(steps))]
            last = max(n["start"] + n["length"] for n in own)
            ends[steps[depth]] = max(last, ends.get(steps[depth], 0))
    starts = sorted((n["tree"], n["start"], ends[n["node"]]) for n in nodes)
    for (t1, a1, b1), (t2, a2, b2) in zip(starts, starts[1:]):
        assert t1 != t2 or b2 <= b1 or a2 >= b1


def test_odd_rows(spark):
    long = "word " * 100_000
    rows = [
        (None, 1, "user", "no conversation"),
        (None, None, "assistant", "no turn"),
        (3, 1, "assistant", "twice"),
        (3, 1, "assistant", "twice"),
        (4, 1, "user", long),
        (4, 2, "assistant", long),
        (5, 1, None, None),
        (6, 1, "user", "same turn"),
        (6, 1, "assistant", "same turn"),
    ]
    assert digests(spark, rows) == brute(rows)[0]
    assert digests(spark, []) == {}


def test_a_broken_tree_is_seen(spark):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    trees = chat_tree.prefix_trees(frame(spark, conversations(6)), TOKENIZER)
    trees.nodes = trees.nodes.withColumn("start", F.col("start") + F.col("depth"))
    try:
        chat_tree.read_back(trees, TOKENIZER).collect()
    except PythonException as error:
        assert "intervals" in str(error)
    else:
        raise AssertionError("not seen")
