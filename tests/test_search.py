"""Pruning step by step and proposed settings, against plain loops."""

import math
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from verbena.operators import joins
from verbena.operators.proposals import propose_trials
from verbena.operators.pruning import prune_running, running_signed_rank
from verbena.operators.trials import prune_trials, range_scores, signed_rank

STEPS = "study string, trial long, step int, loss double"


def plain_rank(differences):
    """m, w_plus, z of a list of differences."""
    rest = sorted((abs(d), d) for d in differences if d)
    sizes = [s for s, _ in rest]
    m = len(rest)
    rank = {s: sizes.index(s) + (sizes.count(s) + 1) / 2 for s in set(sizes)}
    plus = sum(rank[s] for s, d in rest if d > 0)
    ties = sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
    variance = m * (m + 1) * (2 * m + 1) / 24 - ties / 48
    z = (plus - m * (m + 1) / 4) / math.sqrt(variance) if variance > 0 else None
    return m, plus, z


def differences_of(spark):
    draw = random.Random(5)
    lengths = {1: 1, 2: 2, 3: 33, 4: 130, 5: 7}
    rows = {
        (t, s): float(draw.choice([-3, -2, -1, 0, 0, 1, 1, 2, 2.5])) for t, n in lengths.items() for s in range(n)
    }
    rows |= {(6, s): 0.0 for s in range(4)}
    rows |= {(7, 2 * s): math.inf if s % 2 else -math.inf for s in range(5)}
    return rows, spark.createDataFrame(
        [(t, s, d) for (t, s), d in rows.items()], "trial long, step int, difference double"
    )


@pytest.mark.parametrize("small", [True, False])
def test_rank_after_each_step(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_KEYS", 2)
    rows, df = differences_of(spark)
    got = {(r.trial, r.step): r for r in running_signed_rank(df, ["trial"], "step").collect()}
    assert got.keys() == rows.keys()
    for (trial, step), row in got.items():
        before = [d for (t, s), d in sorted(rows.items()) if t == trial and s <= step]
        m, plus, z = plain_rank(before)
        assert (row.steps, row.m, row.w_plus) == (len(before), m, plus)
        assert row.w_minus == m * (m + 1) / 2 - plus
        assert row.z == (None if z is None else pytest.approx(z, abs=1e-12))


def test_last_step_equals_the_whole_test(spark):
    _, df = differences_of(spark)
    ranked = running_signed_rank(df, ["trial"], "step")
    last = {r.trial: r.last for r in ranked.groupBy("trial").agg(F.max_by(F.struct("m", "w_plus", "z"), "step").alias("last")).collect()}
    for row in signed_rank(df, ["trial"]).collect():
        assert tuple(last[row.trial]) == (row.m, row.w_plus, pytest.approx(row.z) if row.z is not None else None)


def test_differences_without_a_number(spark):
    rows = [(1, 0, 1.0), (1, 1, math.nan), (1, 2, None), (1, 3, 2.0)]
    df = spark.createDataFrame(rows, "trial long, step int, difference double")
    got = sorted((r.step, r.steps, r.m, r.w_plus) for r in running_signed_rank(df, ["trial"], "step").collect())
    assert got == [(0, 1, 1, 1.0), (1, 2, 1, 1.0), (3, 3, 2, 3.0)]


def test_pruned_at_the_first_step_that_speaks(spark):
    draw = random.Random(8)
    loss = {(0, s): 1 / (s + 1) for s in range(40)}
    for t, shift in ((1, 0.3), (2, 0.02), (3, 0.0), (4, -0.001)):
        loss |= {(t, s): 1 / (s + 1) + shift + draw.gauss(0, 0.05) for s in range(3, 40)}
    loss[(0, 39)] = -5.0  # the best of all
    df = spark.createDataFrame([("s", t, s, x) for (t, s), x in loss.items()], STEPS)
    startup = 6
    want = {}
    for t in (1, 2, 3, 4):
        d, want[t] = [], (None, None)
        for s in range(3, 40):
            d.append(loss[t, s] - loss[0, s])
            z = plain_rank(d)[2]
            if len(d) >= startup and z is not None and z > 1.2815515655446004:
                want[t] = (s, len(d))
                break
    got = {r.trial: (r.pruned_at, r.steps) for r in prune_running(df, "study", "trial", "step", "loss", startup).collect()}
    assert got == want and want[1] == (8, 6)
    whole = {r.trial for r in prune_trials(df, "study", "trial", "step", "loss", startup).filter("pruned").collect()}
    assert whole <= {t for t, (at, _) in got.items() if at is not None}


def test_nothing_to_prune(spark):
    empty = spark.createDataFrame([], STEPS)
    assert prune_running(empty, "study", "trial", "step", "loss").count() == 0


TRIALS = "study string, trial long, value double, lr double, kl double"
RANGES = {"lr": (1e-6, 1e-2), "kl": (1.0, 50.0)}


def test_proposals_by_hand(spark):
    rows = [("s", i, float(i), 2e-3 if i < 5 else 3e-5, 5.0 if i % 3 else 20.0) for i in range(20)]
    rows += [("s", 90, None, 1e-3, 2.0), ("s", 91, 0.5, None, math.nan), ("t", 1, 1.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, TRIALS)
    args = (df, "study", "trial", "value", RANGES, 300, 40, 11, 0.25)
    got = sorted(propose_trials(*args).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 41)) and {r.study for r in got} == {"s"}
    assert all((a.score, -a.draw) > (b.score, -b.draw) for a, b in pairwise(got))
    lr = {r.bin: r.score for r in range_scores(df, "study", "trial", "value", "lr").collect() if r.study == "s" and r.bin is not None}
    for r in got:
        assert 1e-3 <= r.lr < 1e-2 and 1 <= r.kl < 50
    assert lr[-3] > lr[-5]  # the good trials' bin, and so the one all are from
    assert propose_trials(*args).exceptAll(propose_trials(*args)).count() == 0


def test_draws_follow_the_good_trials(spark):
    """Without a choice, bins come up as often as their good trials, plus one."""
    rows = [("s", i, float(i), 2e-3 if i % 4 else 3e-5, 5.0) for i in range(400)]
    df = spark.createDataFrame(rows, TRIALS)
    got = propose_trials(df, "study", "trial", "value", RANGES, 4000, 4000, 3, 0.25)
    assert got.count() == 4000
    assert got.filter("lr >= 1e-3").count() / 4000 == pytest.approx(76 / 102, abs=0.03)


def test_no_trials_no_proposals(spark):
    assert propose_trials(spark.createDataFrame([], TRIALS), "study", "trial", "value", RANGES, 9, 3, 1).count() == 0
