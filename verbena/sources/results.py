"""Results below dataset / model / run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUT = ["dataset", "model", "run_ts"]


def write_results(df: DataFrame, root: str, run_ts: str, max_rows: int = 5_000_000) -> None:
    """Write results as Parquet, partitioned so that readers skip other runs.

    The rebalance hint gathers the rows of a folder into few files and lets adaptive
    execution split a folder that is too large for one task. One run's time is one
    folder, so runs never overwrite each other; writing a run again replaces it.
    """
    (
        df.withColumn("run_ts", F.lit(run_ts))
        .hint("rebalance", *[F.col(c) for c in LAYOUT])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy(*LAYOUT)
        .parquet(root)
    )
