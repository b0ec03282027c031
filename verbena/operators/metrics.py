"""Metric logs: epochs, curves, early stopping and accumulated steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.operators.ordering import (
    running,
    running_count,
    running_max,
    running_min,
    value_chunks,
)
from verbena.session import written


def number_epochs(
    log: DataFrame, run: str, ts: str, tiebreak: str, epoch: str = "epoch"
) -> DataFrame:
    """Number the rows of each run from 1 by time; rows without a time come first.

    A run is cut into range partitions of its rows, kept as ``chunk`` so that the curve can be
    cut the same way. They follow the rows, not the calendar: a run that fills one day is split.
    """
    cut = value_chunks(log, [run], [ts, tiebreak]).withColumnRenamed("_chunk", "chunk")
    return written(running(cut, [run], "chunk", [ts, tiebreak], {epoch: running_count()}), "epochs")


def chunk_epochs(metrics: DataFrame, epoch: str = "epoch", size: int = 100_000) -> DataFrame:
    """Add ``chunk`` to metrics that already have epoch numbers."""
    return metrics.withColumn("chunk", F.floor(F.col(epoch) / size))


def loss_curve(
    metrics: DataFrame, run: str, epoch: str = "epoch", loss: str = "loss"
) -> DataFrame:
    """Best so far, epochs since the best, and the change from the epoch before.

    Only a strictly lower loss is a new best: of equal losses the earliest epoch counts,
    which is the least (loss, epoch). A loss that is null or NaN is never the best. Needs
    ``chunk`` from the functions above.
    """
    seen = F.when(
        F.col(loss).isNotNull() & ~F.isnan(loss), F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch"))
    )
    latest = F.struct(F.col(epoch).alias("epoch"), F.col(loss).alias("loss"))
    measured = running(
        metrics,
        [run],
        "chunk",
        [epoch],
        {"_best": running_min(seen), "_previous": running_max(latest, before=True)},
    )
    return measured.select(
        *metrics.columns,
        F.col("_best.loss").alias("best_value"),
        F.col("_best.epoch").alias("best_epoch"),
        (F.col(epoch) - F.col("_best.epoch")).alias("epochs_since_best"),
        (F.col(loss) - F.col("_previous.loss")).alias("change"),
    )


def early_stop(
    metrics: DataFrame,
    run: str,
    patience: int,
    min_epochs: int = 0,
    max_epochs: int | None = None,
    epoch: str = "epoch",
    loss: str = "loss",
) -> DataFrame:
    """Where each run stops: run, stop_epoch, best_epoch, best_value, spent.

    The first epoch from ``min_epochs`` on that lies ``patience`` epochs after the best
    one stops the run (``spent``); otherwise its last epoch does.
    """
    kept = metrics if max_epochs is None else metrics.filter(F.col(epoch) <= max_epochs)
    curve = loss_curve(kept, run, epoch, loss)
    done = (F.col(epoch) >= min_epochs) & (F.col("epochs_since_best") >= patience)
    state = F.struct(
        F.col(epoch).alias("stop_epoch"), F.col("best_epoch"), F.col("best_value")
    )
    ends = curve.groupBy(run).agg(
        F.min(F.when(done, state)).alias("_stopped"), F.max(state).alias("_last")
    )
    return ends.select(
        run,
        F.coalesce("_stopped", "_last").alias("_end"),
        F.col("_stopped").isNotNull().alias("spent"),
    ).select(run, "_end.*", "spent")


def accumulate_steps(
    batch_losses: DataFrame, n: int, by: list[str], batch: str = "batch", loss: str = "loss"
) -> DataFrame:
    """One update per n batches: by, step, batches, loss (their mean)."""
    return batch_losses.groupBy(*by, F.floor(F.col(batch) / n).alias("step")).agg(
        F.count("*").alias("batches"), F.avg(loss).alias("loss")
    )
