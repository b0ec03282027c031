"""Early stopping on a stream of metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = (
    "next_epoch long, best_value double, best_epoch long, stopped boolean, "
    "early_epochs array<long>, early_losses array<double>"
)


def stream_early_stop(
    metrics: DataFrame, run: str, patience: int, min_epochs: int = 0
) -> DataFrame:
    """One row when a run's patience is spent: run, stop_epoch, best_epoch, best_value.

    ``metrics`` is a stream with run, epoch (long, 1, 2, 3 ...) and loss. Files may
    arrive out of order: epochs that come too early wait in the state until the gap
    before them is filled. A stopped run keeps only its mark, so it is never emitted
    twice. Bound the files per trigger to bound what one call sees of a long run.
    """

    def follow(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.exists:
            next_epoch, best_value, best_epoch, stopped, epochs, losses = state.get
            waiting = dict(zip(epochs, losses))
        else:
            next_epoch, best_value, best_epoch, stopped, waiting = 1, None, None, False, {}
        for batch in batches:
            if not stopped:
                new = batch[batch["epoch"] >= next_epoch]
                waiting.update(zip(new["epoch"].tolist(), new["loss"].tolist()))
        while not stopped and next_epoch in waiting:
            epoch, loss = next_epoch, waiting.pop(next_epoch)
            next_epoch += 1
            if pd.notna(loss) and (best_value is None or loss < best_value):
                best_value, best_epoch = loss, epoch
            if best_epoch is not None and epoch >= min_epochs and epoch - best_epoch >= patience:
                stopped = True
                yield pd.DataFrame(
                    {
                        run: [key[0]],
                        "stop_epoch": [epoch],
                        "best_epoch": [best_epoch],
                        "best_value": [best_value],
                    }
                )
        if stopped:
            waiting = {}
        state.update(
            (next_epoch, best_value, best_epoch, stopped, list(waiting), list(waiting.values()))
        )

    run_type = metrics.schema[run].dataType.simpleString()
    return (
        metrics.select(run, "epoch", "loss")
        .groupBy(run)
        .applyInPandasWithState(
            follow,
            outputStructType=(
                f"{run} {run_type}, stop_epoch long, best_epoch long, best_value double"
            ),
            stateStructType=STATE,
            outputMode="append",
            timeoutConf=GroupStateTimeout.NoTimeout,
        )
    )


def write_stops(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends stopped runs to a Parquet folder, exactly once each."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
