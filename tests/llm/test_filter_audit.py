"""The filter audit against applying every order to every row."""

import random
import re
from itertools import permutations

from verbena.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask string, n int, part int"


def failed(rows):
    """The set of filters that each row fails."""
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        marks = ""
        marks += "A" * (len(words) < 200)
        marks += "B" * (100 * len(set(words)) < 50 * len(words))
        marks += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        marks += "D" * bool(re.search(r"[#$%&*|]", text))
        marks += "E" * (doc_id is not None and doc_id > least[text])
        out.append(set(marks))
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    masks = failed(rows)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    table = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], m) for r, m in zip(rows, masks) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                fails = sum(letter in m for _, m in mine)
                table[part, order, step] = dict(
                    zip(
                        names,
                        [
                            len(left),
                            len(gone),
                            fails - len(gone),
                            sum(m == {letter} for _, m in mine),
                            sum(d in good for d, _ in gone),
                            sum(d in toxic for d, _ in gone),
                        ],
                    )
                )
    shares = {}
    for (part, order, step), row in table.items():
        at = part, order[step - 1]
        shares[at] = shares.get(at, 0) + row["removed"]
    for (part, order, step), row in table.items():
        row["shapley"] = shares[part, order[step - 1]]
    return table


def found(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = [r.asDict() for r in filter_audit.audit_filters(docs, marks).collect()]
    keyed = {(r.pop("part"), r.pop("filter_order"), r.pop("step")): r for r in out}
    assert len(keyed) == len(out)
    return keyed


def texts(rng):
    words = [f"w{k}" for k in range(400)]
    out = ["", "short", "AB CD", "x " * 300, "a\x0b\x0cb " * 120, "É Ünï " * 150, "| " * 4]
    for _ in range(60):
        own = [rng.choice(words[: rng.choice([5, 90, 400])]) for _ in range(rng.choice([20, 199, 200, 420]))]
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = rng.choice(["#", "HELLO" * 8, "a%b"])
        out.append(rng.choice([" ", "\n"]).join(own))
    return out


def test_every_order(spark):
    rng = random.Random(3)
    pool = texts(rng)
    rows = []
    for k in range(260):
        text = rng.choice(pool[:12] if rng.random() < 0.5 else pool)
        rows.append((k, text, rng.choice(["a", "a", "b", "", None]), "x", 1, 2))
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 260, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_odd_rows(spark):
    long = "word " * 100_000
    rows = [
        (1, None, None, "x", 1, 2),
        (1, None, None, "x", 1, 2),
        (2, "", "", None, None, None),
        (None, "", "s", "x", 1, 2),
        (None, "", "s", "x", 1, 2),
        (3, long, "s", "x", 1, 2),
        (4, long, "t", "x", 1, 2),
        (4, long, "s", "x", 1, 2),
    ]
    labels = [(1, 1, 1), (None, 1, 1)]
    assert found(spark, rows, labels) == brute(rows, labels)
    assert found(spark, rows, []) == brute(rows, [])
    assert found(spark, [], labels) == {}


def test_intervals_cover_every_rank_once():
    for size in (1, 2, 3, 5):
        intervals = filter_audit.removal_intervals(size)
        orders = filter_audit.order_names("ABCDE"[:size])
        for mask in range(1, 1 << size):
            steps = {}
            for m, step, first, last in intervals:
                if m == mask:
                    for rank in range(first, last):
                        assert rank not in steps
                        steps[rank] = step
            for rank, order in enumerate(orders):
                inside = [mask >> "ABCDE".index(x) & 1 for x in order]
                assert steps[rank] == inside.index(1) + 1


def test_query_has_every_row(frame):
    rows = frame("op13_filter_audit")
    parts = {r["part"] for r in rows.select("part").distinct().collect()}
    assert rows.count() == len(parts) * 120 * 5
