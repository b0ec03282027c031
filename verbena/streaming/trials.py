"""The tail of a search journal as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.operators.trials import latest_trial_state


def stream_latest_trials(
    spark: SparkSession,
    log_dir: str,
    schema: str,
    by: list[str],
    seq: str,
    values: list[str],
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Streaming table with the last entry of each trial; write it in update mode."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return latest_trial_state(reader.json(log_dir), by, seq, values)


def write_updates(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that writes each batch of changed rows to ``path``/batch=<n>.

    A batch that is run again after a failure replaces its own folder.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def current_rows(spark: SparkSession, path: str, by: list[str], seq: str) -> DataFrame:
    """What the written updates come to: the row with the highest seq of each trial."""
    updates = spark.read.parquet(path).drop("batch")
    others = [c for c in updates.columns if c not in (*by, seq)]
    entry = F.struct(F.col(seq), *others)
    return updates.groupBy(*by).agg(F.max(entry).alias("_last")).select(*by, "_last.*")


def compact_updates(spark: SparkSession, path: str, by: list[str], seq: str) -> None:
    """Replace all updates written so far by one folder with the rows they come to.

    The new folder is complete before the old ones go, and a row that stands in both counts once,
    so a job lost half-way, or a batch that is written again later, changes no result. To be called
    while no batch is being written.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    last = max((abs(int(p.getName().split("=")[1])) for p in old), default=None)
    if last is None or len(old) == 1:
        return
    current_rows(spark, path, by, seq).write.parquet(f"{path}/batch={-(last + 1)}")
    for folder in old:
        system.delete(folder, True)
