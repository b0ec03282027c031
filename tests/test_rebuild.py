"""Texts rebuilt and options nested without a shuffle of single rows."""

import json

import pytest
from pyspark.sql import functions as F

from verbena.operators.options import nest_options
from verbena.operators.tokens import rebuild_text, tokenize


def test_odd_tokens_and_texts_that_come_twice(spark):
    rows = [
        (1, 0, "b"), (1, 1, "c d"), (1, 2, "e"), (1, 0, "a"), (1, 1, "x"), (1, 5, None), (1, 4, ""),
        (None, 1, "n"), (None, 0, "m"), (2, 0, "p"), (2, 1, "q"), (2, 3, "r"), (3, None, "s"), (3, 0, "t"),
    ]
    tokens = spark.createDataFrame(rows, "k long, pos int, token string")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    joined = F.array_join(F.transform(ordered, lambda at: at["token"]), " ").alias("text")
    plain = {r.k: r.text for r in tokens.groupBy("k").agg(joined).collect()}
    assert {r.k: r.text for r in rebuild_text(tokens, ["k"]).collect()} == plain
    texts = spark.createDataFrame([(1,), (1,), (None,), (9,)], "k long")
    got = sorted(map(str, ((r.k, r.text) for r in rebuild_text(tokens, ["k"], texts).collect())))
    assert got == sorted(map(str, [(1, plain[1]), (None, plain[None]), (9, "")]))


def shuffled(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_move_joined_and_once(spark):
    docs = spark.range(100).select("id", F.repeat(F.lit("word of a text "), 200).alias("text"))
    out = rebuild_text(tokenize(docs, ["id"]), ["id"], docs.select("id"))
    assert shuffled(out) == 1 and "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.text for r in out.collect()} == {("word of a text " * 200).strip()}


@pytest.mark.parametrize("twice", [False, True])
def test_each_leaf_moves_once(spark, twice):
    leaves = [("a.b.c", "1"), ("a.d", "2"), ("e", "3"), ("a.b.f", "4"), ("g.h", "5")]
    rows = [(run, k, v) for run in range(40) for k, v in leaves * (2 if twice else 1)]
    flat = spark.createDataFrame(rows, "run int, key string, value string")
    out = nest_options(flat, ["run"])
    # One for each depth's leaves, none for the groups.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 3
    got = {r.run: json.loads(r.options) for r in out.collect()}
    whole = {"a": {"b": {"c": "1", "f": "4"}, "d": "2"}, "e": "3", "g": {"h": "5"}}
    assert got == {run: whole for run in range(40)}
