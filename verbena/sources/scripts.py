"""Job scripts as a long option table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMENT = r"`#[^`]*`"
CONTINUATION = r"\\\r?\n\s*"
COMMAND = r"(?m)^python\s+\S+[ \t]*(.*)$"
# An option: its key, then all words up to the next option.
OPTION = r"--[A-Za-z_][\w.]*(?:\s+(?:\"[^\"]*\"|(?!--)[^\s\"]+))*"
WORD = r"\"[^\"]*\"|[^\s\"]+"


def parse_run_scripts(scripts: DataFrame, run: str, text: str = "text") -> DataFrame:
    """run, key, pos, value: one row per option value of each script's command.

    A flag gives one row with a null value. All of it happens inside the row of a
    script, without a shuffle.
    """
    joined = F.regexp_replace(F.regexp_replace(text, COMMENT, " "), CONTINUATION, " ")
    command = scripts.select(run, F.regexp_extract(joined, COMMAND, 1).alias("_args"))
    options = command.select(
        run, F.explode(F.regexp_extract_all("_args", F.lit(OPTION), F.lit(0))).alias("_option")
    )
    words = options.select(
        run, F.regexp_extract_all("_option", F.lit(WORD), F.lit(0)).alias("_words")
    )
    values = F.slice("_words", F.lit(2), F.size("_words"))
    return words.select(
        run,
        F.substr(F.col("_words")[0], F.lit(3)).alias("key"),
        F.posexplode_outer(values).alias("pos", "value"),
    ).select(run, "key", F.coalesce("pos", F.lit(0)).alias("pos"), "value")


def read_run_configs(
    spark: SparkSession, path: str, files: str = "*.sh", name: str = r"([^/]+)\.sh$"
) -> DataFrame:
    """The option table of all job scripts below a folder.

    run_id is the part of the path that ``name`` picks, by default the file name.
    """
    in_path = F.regexp_extract("_metadata.file_path", name, 1)
    scripts = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", files)
        .text(path, wholetext=True)
        .select(
            # A plus sign stays one; only percent codes are decoded.
            F.url_decode(F.replace(in_path, F.lit("+"), F.lit("%2B"))).alias("run_id"),
            F.col("value").alias("text"),
        )
    )
    return parse_run_scripts(scripts, "run_id")
