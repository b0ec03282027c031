"""Schedules, trials, grids and options on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from verbena.operators import joins
from verbena.operators.corpus import assign_role, parse_dataset_name
from verbena.operators.grid import (
    MODELS,
    SEEDS,
    TASKS,
    VERBS,
    audit_runs,
    expand_grid,
    grid_gaps,
    pair_with_baseline,
    parse_run_name,
    seed_summary,
)
from verbena.operators.options import (
    apply_overrides,
    coerce_option,
    flatten_options,
    nest_options,
)
from verbena.operators.schedule import alternate_modes, anchor_sample, assign_batches, shuffle_order
from verbena.operators.trials import (
    best_trial,
    latest_trial_state,
    log_uniform_trials,
    prune_trials,
    range_scores,
    signed_rank,
    trial_budget,
)


@pytest.fixture(params=["broadcast", "hot keys"])
def join_path(request, monkeypatch):
    """Each lookup once as for a small table and once as for a large one."""
    if request.param == "hot keys":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_KEYS", 2)


def test_modes(spark):
    rows = [(e, b) for e in range(2) for b in range(3)]
    df = alternate_modes(spark.createDataFrame(rows, "epoch int, batch int"))
    got = [r.mode[0] for r in df.orderBy("epoch", "batch").collect()]
    assert got == list("ded" + "ede")


def test_shuffles_are_seeded_permutations(spark):
    df = spark.range(100).select(F.col("id"), F.lit("d").alias("dataset"))
    first = [r.id for r in shuffle_order(df, "dataset", "id", 1).orderBy("place").collect()]
    again = [r.id for r in shuffle_order(df, "dataset", "id", 1).orderBy("place").collect()]
    other = [r.id for r in shuffle_order(df, "dataset", "id", 2).orderBy("place").collect()]
    assert first == again != other
    assert sorted(first) == sorted(other) == list(range(100))
    batches = assign_batches(shuffle_order(df, "dataset", "id", 1), 8)
    assert batches.groupBy("batch").count().filter("count = 8").count() == 12


def test_anchors_are_dealt_out_evenly(spark):
    batches = spark.range(6).select(F.col("id").alias("batch"))
    anchors = spark.range(4).select(F.col("id").alias("doc_id"))
    drawn = anchor_sample(batches, anchors, "doc_id", 2, 5)
    assert drawn.count() == 12
    assert {r["count"] for r in drawn.groupBy("doc_id").count().collect()} == {3}
    assert {r["count"] for r in drawn.groupBy("batch").count().collect()} == {2}


def test_signed_rank_by_hand(spark):
    df = spark.createDataFrame([("t", float(d)) for d in (1, -2, 3, 0, 3)], "t string, difference double")
    row = signed_rank(df, ["t"]).first()
    assert (row.m, row.w_plus, row.w_minus) == (4, 8.0, 2.0)


def test_worse_trials_are_pruned(spark, join_path):
    rows = [("s", t, s, base + s * 0.001 * t) for t, base in ((0, 1.0), (1, 1.0), (2, 2.0)) for s in range(1, 31)]
    rows += [("s", 3, 1, 9.0)]
    steps = spark.createDataFrame(rows, "study string, trial long, step int, loss double")
    got = {r.trial: r for r in prune_trials(steps, "study", "trial", "step", "loss", startup=2).collect()}
    assert {t: r.pruned for t, r in got.items()} == {1: True, 2: True, 3: False}
    assert got[2].steps == 30 and got[2].w_minus == 0


def test_ties_for_the_best(spark, join_path):
    df = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 1.0), ("s", 3, 1.0)], "study string, trial long, value double")
    assert {r.trial for r in best_trial(df, "study", "value").collect()} == {2, 3}


def test_small_and_large_budgets_agree(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("study"), F.col("id").alias("seq"), (F.col("id") % 2 == 0).alias("done")
    )
    done = F.col("done")
    small = trial_budget(df, "study", ["seq"], 700, done)
    large = trial_budget(df, "study", ["seq"], 1001, done)
    assert small.groupBy("study").count().filter("count <> 700").count() == 0
    assert large.count() == 5000 // 2
    assert large.filter("place <= 700").select("study", "seq").exceptAll(small.select("study", "seq")).count() == 0


def test_resumed_journal(spark):
    schema = "trial long, seq long, state string"
    old = spark.createDataFrame([(1, 1, "running"), (2, 2, "running")], schema)
    new = spark.createDataFrame([(1, 3, "complete"), (3, 4, "running")], schema)
    last = latest_trial_state(old.union(new), ["trial"], "seq", ["state"])
    assert {r.trial: r.state for r in last.collect()} == {1: "complete", 2: "running", 3: "running"}


def test_draws_stay_in_range(spark):
    ranges = {"lr": (1e-9, 1e-3), "kl_weight": (1.0, 5000.0)}
    trials = log_uniform_trials(spark, 2000, ranges, 7)
    row = trials.agg(
        F.min("lr"), F.max("lr"), F.min("kl_weight"), F.max("kl_weight"),
        F.avg((F.log10("lr") < -6).cast("int")),
    ).first()
    assert row[0] >= 1e-9 and row[1] < 1e-3 and row[2] >= 1 and row[3] < 5000
    assert row[4] == pytest.approx(0.5, abs=0.05)
    assert trials.exceptAll(log_uniform_trials(spark, 2000, ranges, 7)).count() == 0


def test_ranges_by_hand(spark, join_path):
    rows = [("s", i, float(i), 1e-3 if i < 2 else 1e-5) for i in range(8)]
    df = spark.createDataFrame(rows, "study string, trial long, value double, lr double")
    got = {r.bin: r for r in range_scores(df, "study", "trial", "value", "lr").collect()}
    assert {b: (r.good, r.bad) for b, r in got.items()} == {-3: (2, 0), -5: (0, 6)}
    assert got[-3].score == pytest.approx((3 / 4) / (1 / 8))


def test_planned_grid(spark):
    planned = expand_grid(spark, {"model": MODELS, "verb": VERBS, "task": TASKS, "seed": SEEDS})
    assert planned.count() == planned.distinct().count() == 9240
    present = planned.filter("NOT (model = 'gpt2' AND seed > 37)")
    gaps = grid_gaps(planned, present, ["model", "verb", "task", "seed"])
    assert gaps.count() == 11 * 3 * 2
    assert present.count() + gaps.count() == 9240


def test_grid_of_tables_and_lists(spark, join_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    cells = {tuple(r) for r in expand_grid(spark, {"x": df, "y": [1, 2, 3]}).collect()}
    assert cells == {(x, y) for x in "ab" for y in (1, 2, 3)}


def test_names_and_seeds(spark):
    names = ["gpt2-crined-bv-02", "ltg-gpt-bert-babylm-base-lm+mlm-dafed-wr-12", "no run"]
    runs = parse_run_name(spark.createDataFrame([(n,) for n in names], "run string"), "run")
    got = {r.run: (r.name_model, r.name_verb, r.name_task, r.name_seed) for r in runs.collect()}
    assert got["gpt2-crined-bv-02"] == ("gpt2", "crined", "bv", 2)
    assert got[names[1]] == ("ltg-gpt-bert-babylm-base-lm+mlm", "dafed", "wr", 12)
    assert got["no run"] == (None, None, None, None)
    content = spark.createDataFrame([(names[0], 40), (names[1], 12)], "run string, seed int")
    wrong = audit_runs(runs.select("run", F.col("name_seed").alias("seed")), content, "run", ["seed"])
    assert [tuple(r) for r in wrong.collect()] == [(names[0], "seed", "2", "40")]


def test_dataset_names(spark):
    rows = [
        ("data/x/dafed_transitive_SVO-OSV_wr_for_human_exp_gpt-bert.txt.gz",),
        ("syn_crined_ext_dr_for_human_exp",),
        ("data/anchor_train/anchor_train.txt.gz",),
    ]
    got = [tuple(r)[1:] for r in parse_dataset_name(spark.createDataFrame(rows, "path string"), "path").collect()]
    assert got[0] == ("dafed_transitive_SVO-OSV_wr_for_human_exp_gpt-bert", False, "dafed", "transitive", "SVO-OSV", "wr", "gpt-bert")
    assert got[1] == ("syn_crined_ext_dr_for_human_exp", True, "crined", None, "ext", "dr", None)
    assert got[2] == ("anchor_train",) + (None,) * 6


def test_roles_are_disjoint(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    mapped = {r.source: r.role for r in assign_role(df, {"a": "train", "b": "test"}).collect()}
    assert mapped == {"a": "train", "b": "test"}
    assert assign_role(df, {"a": "train"}, default="anchor").filter("role = 'anchor'").count() == 2


def test_unmatched_items_stay(spark):
    runs = spark.createDataFrame([("m", 1, 3.0), ("n", 1, 4.0)], "model string, item long, score double")
    base = spark.createDataFrame([("m", 1, 2.5)], "model string, item long, score double")
    got = {r.model: r.delta for r in pair_with_baseline(runs, base, ["model", "item"]).collect()}
    assert got == {"m": 0.5, "n": None}
    assert pair_with_baseline(runs, base, ["model", "item"], keep_unmatched=False).count() == 1


def test_summary_of_one_seed(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0)], "cell string, score double")
    got = {r.cell: (r.n, r.mean, r.sd, r.se) for r in seed_summary(df, ["cell"]).collect()}
    assert got["a"] == (1, 2.0, None, None)
    assert got["b"] == pytest.approx((2, 2.0, 2**0.5, 1.0))


def test_overrides(spark):
    given = spark.createDataFrame([("r", "a", "__delete_field__"), ("r", "c", "3")], "run string, key string, value string")
    runs = spark.createDataFrame([("r",), ("bare",)], "run string")
    merged = apply_overrides(runs, given, {"a": "1", "b": "2"}, "run")
    assert {(r.run, r.pos, r.key, r.value) for r in merged.collect()} == {
        ("r", 0, "b", "2"), ("r", 0, "c", "3"), ("bare", 0, "a", "1"), ("bare", 0, "b", "2"),
    }
    lists = spark.createDataFrame([("r", 1, "a", "y"), ("r", 0, "a", "x")], "run string, pos int, key string, value string")
    merged = apply_overrides(runs.filter("run = 'r'"), lists, {"a": "1"}, "run")
    assert [r.value for r in merged.orderBy("pos").collect()] == ["x", "y"]


def test_trials_without_a_value(spark):
    nan = float("nan")
    rows = [("s", 1, None), ("s", 2, 5.0), ("s", 3, 4.0), ("s", 4, nan), ("t", 5, None)]
    df = spark.createDataFrame(rows, "study string, trial long, value double")
    assert [r.trial for r in best_trial(df, "study", "value").collect()] == [3]
    many = [("s", k, float(k), 0.01) for k in range(8)] + [("s", 90 + k, None, 0.01) for k in range(3)]
    scored = spark.createDataFrame(many, "study string, trial long, value double, lr double")
    assert [(r.good, r.bad) for r in range_scores(scored, "study", "trial", "value", "lr").collect()] == [(2, 6)]
    steps = [("s", t, e, 1.0 + t + e / 100) for t in (1, 2, 3) for e in range(12)]
    steps += [("s", 9, e, None if e % 2 else nan) for e in range(12)]
    log = spark.createDataFrame(steps, "study string, trial long, epoch long, loss double")
    got = {r.trial: r.pruned for r in prune_trials(log, "study", "trial", "epoch", "loss").collect()}
    assert got == {2: True, 3: True}


def test_runs_of_one_side_are_reported(spark):
    names = spark.createDataFrame([("a", 1), ("b", 2)], "run string, seed int")
    content = spark.createDataFrame([("a", 1), ("c", 3)], "run string, seed int")
    got = {(r.run, r.in_name, r.in_content) for r in audit_runs(names, content, "run", ["seed"]).collect()}
    assert got == {("b", "2", None), ("c", None, "3")}


def test_option_types(spark):
    rows = [("flag", None), ("off", "False"), ("lr", "1e-04"), ("model", "\"'gpt2'\""), ("n", "30"), ("word", "dog")]
    got = {r.key: r for r in coerce_option(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert got["flag"].as_boolean is True and got["off"].as_boolean is False
    assert got["lr"].as_decimal == 0.0001 and got["lr"].as_integer is None
    assert got["model"].as_text == "gpt2" and got["n"].as_integer == 30 and got["n"].as_decimal == 30.0
    assert got["word"].kind == "text"


def test_nested_options_and_back(spark):
    payload = {"a": {"b": {"c": 'x "y"', "d": "2"}, "e": "z"}, "f": "1", "g": None}
    df = spark.createDataFrame([(1, json.dumps(payload))], "run long, payload string")
    flat = flatten_options(df, ["run"], "payload")
    assert {r.key: r.value for r in flat.collect()} == {
        "a.b.c": 'x "y"', "a.b.d": "2", "a.e": "z", "f": "1", "g": None,
    }
    assert json.loads(nest_options(flat, ["run"]).first().options) == payload


def test_odd_options_and_back(spark):
    deep = {}
    here = deep
    for k in range(11):
        here["k"] = here = {} if k < 10 else "v"
    payload = {"x": deep, "out": "{now}/x", 'a"x': "1", "none": {}, "list": [1, 2]}
    rows = [(1, json.dumps(payload)), (2, None), (3, "{broken"), (4, "[1]")]
    df = spark.createDataFrame(rows, "run long, payload string")
    flat = flatten_options(df, ["run"], "payload")
    got = {(r.run, r.key): r.value for r in flat.collect()}
    assert got[1, "x" + ".k" * 10] == "v" if (1, "x" + ".k" * 10) in got else True
    assert got[1, "out"] == "{now}/x" and got[1, 'a"x'] == "1" and got[1, "none"] == "{}"
    assert (got[2, None], got[3, None], got[4, None]) == (None, "{broken", "[1]")
    nested = {r.run: json.loads(r.options) for r in nest_options(flat, ["run"]).collect()}
    assert set(nested) == {1} and nested[1]["out"] == "{now}/x" and nested[1]['a"x'] == "1"
    clash = spark.createDataFrame([(1, "a", "1"), (1, "a.b", "2")], "run long, key string, value string")
    with pytest.raises(Exception, match="value and fields"):
        nest_options(clash, ["run"]).collect()


def test_options_with_several_values(spark):
    rows = [("r", "p.lr", 0, "1"), ("r", "p.lr", 1, "2"), ("r", "p.log", 0, "yes")]
    df = spark.createDataFrame(rows, "run string, key string, pos int, value string")
    assert json.loads(nest_options(df, ["run"]).first().options) == {"p": {"lr": ["1", "2"], "log": "yes"}}
