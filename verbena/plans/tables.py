"""The test tables in the part they play: corpora, roles, metric logs, trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.operators.corpus import assign_role
from verbena.operators.metrics import number_epochs
from verbena.session import spread

# Word lists that occur in the test texts; their overlaps copy those of the real lists.
STAND_INS = {
    "own_a": "the of and to is in that it".split(),
    "own_b": "for on was with as this be are".split(),
    "own_c": "it by from at an or then than".split(),
    "filler_1": "der die und le la les des el los que con por".split(),
    "filler_2": "the of and to is in that for on by from".split(),
}
ROLES = {"src1": "train", "src2": "validation"}
PARTS = ["train", "base"]
SEED = 42


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as train and base: the base model sees all but the train source."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    return assign_role(docs, {"src1": "train"}, default="base").drop("source")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of each document."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric logs: run, epoch, loss, chunk."""
    log = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss")
    )
    return number_epochs(log, "run", "ts", "event_id").select("run", "epoch", "loss", "chunk")


def words_of(name: str) -> str:
    return ", ".join(f"'{w}'" for w in STAND_INS[name])


def words_in(*names: str) -> str:
    """SQL list of the distinct words of some lists."""
    return ", ".join(f"'{w}'" for w in sorted({w for n in names for w in STAND_INS[n]}))


# SQL twins of the frames above.
TOK = """tok AS (
  SELECT doc_id, source, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents))"""
CONV = """conv AS (
  SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS t FROM conversations))"""
BENCH = """bench AS (
  SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM benchmark))"""
METRICS = """metrics AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         value AS loss
  FROM events)"""
