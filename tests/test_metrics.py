"""Early stopping and curves against hand-made cases and a plain loop."""

import random

import pytest

from verbena.operators.metrics import accumulate_steps, chunk_epochs, early_stop, loss_curve


def frame(spark, runs, size=100_000):
    rows = [(run, e, float(x)) for run, xs in runs.items() for e, x in enumerate(xs, 1)]
    return chunk_epochs(spark.createDataFrame(rows, "run string, epoch long, loss double"), size=size)


def loop(losses, patience, min_epochs=0, max_epochs=None):
    best, best_epoch = None, None
    kept = losses[:max_epochs] if max_epochs else losses
    for epoch, loss in enumerate(kept, 1):
        if best is None or loss < best:
            best, best_epoch = loss, epoch
        if epoch >= min_epochs and epoch - best_epoch >= patience:
            return epoch, best_epoch, best, True
    return len(kept), best_epoch, best, False


def stops(df, *args, **kw):
    return {
        r.run: (r.stop_epoch, r.best_epoch, r.best_value, r.spent)
        for r in early_stop(df, "run", *args, **kw).collect()
    }


@pytest.mark.parametrize(
    "losses, patience, min_epochs, expected",
    [
        ([5, 4, 4, 4, 3, 2, 1], 2, 3, (4, 2, 4.0, True)),
        ([1, 2, 3, 4], 1, 4, (4, 1, 1.0, True)),
        ([3, 2, 1], 3, 0, (3, 3, 1.0, False)),
    ],
)
def test_hand_made_runs(spark, losses, patience, min_epochs, expected):
    assert stops(frame(spark, {"a": losses}), patience, min_epochs) == {"a": expected}


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_random_runs_equal_a_loop(spark, size):
    rng = random.Random(3)
    runs = {
        f"r{i}": [rng.randrange(40) + 40 / (1 + e) for e in range(rng.randrange(1, 90))]
        for i in range(25)
    }
    mine = stops(frame(spark, runs, size), 6, 9, 60)
    assert mine == {run: loop(xs, 6, 9, 60) for run, xs in runs.items()}


def test_curve_over_chunk_borders(spark):
    rows = loss_curve(frame(spark, {"a": [4, 3, 5, 3, 1]}, size=2), "run").orderBy("epoch").collect()
    assert [r.best_epoch for r in rows] == [1, 2, 2, 2, 5]
    assert [r.change for r in rows] == [None, -1.0, 2.0, -2.0, -2.0]
    assert [r.epochs_since_best for r in rows] == [0, 0, 1, 2, 0]


def test_a_missing_loss_is_no_improvement(spark):
    df = frame(spark, {"a": [4, 3, 5, 6]})
    df = df.withColumn("loss", df.loss.cast("double")).replace(3.0, None, ["loss"])
    assert stops(df, 3) == {"a": (4, 1, 4.0, True)}


def test_accumulated_steps(spark):
    rows = [(0, b, float(b)) for b in range(5)]
    df = spark.createDataFrame(rows, "epoch long, batch long, loss double")
    got = {r.step: (r.batches, r.loss) for r in accumulate_steps(df, 2, ["epoch"]).collect()}
    assert got == {0: (2, 0.5), 1: (2, 2.5), 2: (1, 4.0)}
