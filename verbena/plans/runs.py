"""Schedules, metric logs, trials and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.operators.metrics import accumulate_steps, early_stop, loss_curve
from verbena.operators.proposals import propose_trials
from verbena.operators.pruning import prune_running
from verbena.operators.schedule import (
    alternate_modes,
    anchor_sample,
    assign_batches,
    modes_of_passes,
    shuffle_order,
)
from verbena.operators.trials import (
    best_trial,
    latest_trial_state,
    prune_trials,
    range_scores,
    trial_budget,
    with_log_uniform,
)
from verbena.plans.registry import query
from verbena.plans.tables import METRICS, SEED, metrics, read
from verbena.session import fresh_path, written
from verbena.sources.journal import JournalSnapshot, append_journal, read_journal
from verbena.streaming.early_stop import stream_early_stop, write_stops
from verbena.streaming.trials import current_rows, stream_latest_trials, write_updates

PATIENCE, MIN_EPOCHS = 10, 15
BATCH = 8
# The ranges that the searches draw from.
RANGES = {"lr": (1e-9, 1e-3), "kl_weight": (1.0, 5000.0)}

PLACED = f"""placed AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source
           ORDER BY md5('{SEED}:0:' || doc_id), doc_id) AS place
  FROM documents)"""


def placed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and the shuffled place; the texts stay where they are."""
    ids = read(spark, sf_dir, "documents").select("doc_id", "source")
    return shuffle_order(ids, "source", "doc_id", SEED)


@query("shuffle_order", f"WITH {PLACED} SELECT doc_id, source, place FROM placed")
def documents_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_documents(spark, sf_dir)


@query(
    "assign_batches",
    f"""WITH {PLACED} SELECT doc_id, source, (place - 1) // {BATCH} AS batch,
           (place - 1) % {BATCH} AS slot FROM placed""",
)
def documents_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_batches(placed_documents(spark, sf_dir), BATCH).drop("place")


@query(
    "alternate_modes",
    f"""WITH {PLACED} SELECT source, epoch, (place - 1) // {BATCH} AS batch,
           CASE WHEN (epoch + (place - 1) // {BATCH}) % 2 = 0 THEN 'decoder' ELSE 'encoder' END AS mode,
           count(*) AS rows
    FROM placed CROSS JOIN (VALUES (0), (1), (2)) AS e(epoch) GROUP BY ALL""",
)
def modes_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = assign_batches(placed_documents(spark, sf_dir), BATCH)
    counted = batches.groupBy("source", "batch").agg(F.count("*").alias("rows"))
    epochs = counted.select("*", F.explode(F.lit([0, 1, 2])).alias("epoch"))
    return alternate_modes(epochs).select("source", "epoch", "batch", "mode", "rows")


@query(
    "test_pass_modes",
    """SELECT pass_no, item_id, CASE WHEN pass_no % 2 = 0 THEN 'encoder' ELSE 'decoder' END AS mode
    FROM benchmark CROSS JOIN (VALUES (0), (1)) AS p(pass_no)""",
)
def modes_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = read(spark, sf_dir, "benchmark").select(
        F.explode(F.lit([0, 1])).alias("pass_no"), "item_id"
    )
    return modes_of_passes(passes)


@query(
    "anchor_sample",
    f"""WITH batches AS (
      SELECT DISTINCT (row_number() OVER (ORDER BY md5('{SEED}:0:' || conv_id), conv_id) - 1)
               // {BATCH} AS batch
      FROM (SELECT DISTINCT conv_id FROM conversations)),
    anchors AS (
      SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS place
      FROM documents),
    wanted AS (
      SELECT batch, draw, (batch * 10 + draw) % (SELECT count(*) FROM anchors) AS place
      FROM batches CROSS JOIN range(10) AS d(draw))
    SELECT batch, draw::INTEGER AS draw, doc_id FROM wanted JOIN anchors USING (place)""",
)
def anchors_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(
        "conv_id", F.lit("conversations").alias("dataset")
    )
    placed = shuffle_order(turns.distinct(), "dataset", "conv_id", SEED)
    batches = assign_batches(placed, BATCH).select("batch").distinct()
    return anchor_sample(batches, read(spark, sf_dir, "documents"), "doc_id", 10, SEED)


CURVE = f"""{METRICS}, curve AS (
  SELECT run, epoch, loss, min(loss) OVER w AS best_value,
         loss - lag(loss) OVER (PARTITION BY run ORDER BY epoch) AS change,
         min(loss) OVER (PARTITION BY run ORDER BY epoch
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM metrics WINDOW w AS (PARTITION BY run ORDER BY epoch)),
followed AS (
  SELECT *, max(CASE WHEN before IS NULL OR loss < before THEN epoch END)
              OVER (PARTITION BY run ORDER BY epoch) AS best_epoch
  FROM curve)"""


@query(
    "loss_curve",
    f"""WITH {CURVE} SELECT run, epoch, loss, best_value, best_epoch,
           epoch - best_epoch AS epochs_since_best, round(change, 6) AS change FROM followed""",
)
def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = loss_curve(metrics(spark, sf_dir), "run").drop("chunk")
    return curve.withColumn("change", F.round("change", 6))


def sql_stops(patience: int, min_epochs: int, where: str = "true") -> str:
    """SQL twin of early stopping."""
    return f"""WITH {CURVE}, kept AS (SELECT * FROM followed WHERE {where}),
    ends AS (
      SELECT run, min(epoch) FILTER (epoch >= {min_epochs} AND epoch - best_epoch >= {patience})
               AS spent_at, max(epoch) AS last_epoch
      FROM kept GROUP BY run)
    SELECT k.run, k.epoch AS stop_epoch, k.best_epoch, k.best_value, spent_at IS NOT NULL AS spent
    FROM ends JOIN kept k ON k.run = ends.run AND k.epoch = coalesce(spent_at, last_epoch)"""


@query("early_stop", sql_stops(PATIENCE, MIN_EPOCHS))
def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return early_stop(metrics(spark, sf_dir), "run", PATIENCE, MIN_EPOCHS)


@query("early_stop_max_epochs", sql_stops(30, 0, "epoch <= 40"))
def stops_within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return early_stop(metrics(spark, sf_dir), "run", 30, max_epochs=40)


@query(
    "accumulate_steps",
    f"""WITH {METRICS} SELECT run, (epoch - 1) // 2 AS step, count(*) AS batches,
           round(avg(loss), 6) AS loss FROM metrics GROUP BY ALL""",
)
def steps_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = metrics(spark, sf_dir).withColumn("batch", F.col("epoch") - 1)
    steps = accumulate_steps(batches, 2, ["run"])
    return steps.withColumn("loss", F.round("loss", 6))


def event_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the entries of a search journal: the event type is the study.

    Every seventh trial is unfinished and every eleventh has failed: null and NaN values.
    """
    trial = F.col("event_id")
    value = F.when(trial % 7 == 0, None).when(trial % 11 == 0, F.lit(float("nan")))
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("study"),
        F.col("event_id").alias("trial"),
        F.col("user_id").alias("worker"),
        "ts",
        value.otherwise(F.col("value")).alias("value"),
    )


FINISHED = "events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0"


@query(
    "best_trial",
    f"""SELECT event_type AS study, event_id AS trial, user_id AS worker, value FROM (
      SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) AS r FROM {FINISHED})
    WHERE r = 1""",
)
def best_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_trial(event_trials(spark, sf_dir), "study", "value").drop("ts")


BUDGET = f"""SELECT event_type AS study, event_id AS trial, user_id AS worker, value, place FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place
      FROM {FINISHED} AND value < 50) WHERE place <= {{n}}"""


@query("trial_budget", BUDGET.format(n=150))
def first_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = event_trials(spark, sf_dir)
    return trial_budget(trials, "study", ["ts", "trial"], 150, F.col("value") < 50).drop("ts")


@query("trial_budget_large", BUDGET.format(n=1500))
def many_first_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = event_trials(spark, sf_dir)
    return trial_budget(trials, "study", ["ts", "trial"], 1500, F.col("value") < 50).drop("ts")


JOURNAL = "study string, trial long, seq long, state string, value double"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal: each user is a trial, each event a new state of it."""
    return read(spark, sf_dir, "events").select(
        F.lit("events").alias("study"),
        F.col("user_id").alias("trial"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("state"),
        "value",
    )


LATEST = """SELECT 'events' AS study, user_id AS trial, event_id AS seq, event_type AS state, value
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    WHERE r = 1"""


@query("latest_trial_state", LATEST)
def last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is written in two goes, as by a search that was resumed."""
    path = fresh_path(spark, "journal")
    log = journal(spark, sf_dir)
    append_journal(log.filter(F.col("state") != "error"), path)
    append_journal(log.filter(F.col("state") == "error"), path)
    entries = read_journal(spark, path, JOURNAL)
    return latest_trial_state(entries, ["study", "trial"], "seq", ["state", "value"])


@query("resume_from_snapshot", LATEST)
def last_states_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that stopped twice: each time its journal is compacted, and only newer files are read."""
    path = fresh_path(spark, "journal-compacted")
    log = journal(spark, sf_dir)
    snapshot = JournalSnapshot(
        spark, f"{path}/snapshots", ["study", "trial"], "seq", ["state", "value"], JOURNAL
    )
    for state in ("error", "click"):
        append_journal(log.filter(F.col("state") == state), f"{path}/log")
        snapshot.compact(f"{path}/log", keep=1)
        snapshot.clear(f"{path}/log")
    append_journal(log.filter(~F.col("state").isin("error", "click")), f"{path}/log")
    return snapshot.replay(f"{path}/log")


@query("stream_latest_trials", LATEST)
def last_states_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "journal-stream")
    append_journal(journal(spark, sf_dir).repartition(8), f"{path}/log")
    stream = stream_latest_trials(
        spark, f"{path}/log", JOURNAL, ["study", "trial"], "seq", ["state", "value"], 4
    )
    write_updates(stream, f"{path}/updates", f"{path}/checkpoint").awaitTermination()
    return current_rows(spark, f"{path}/updates", ["study", "trial"], "seq")


@query(
    "stream_early_stop",
    f"""SELECT run, stop_epoch, best_epoch, best_value
    FROM ({sql_stops(PATIENCE, MIN_EPOCHS)}) WHERE spent""",
)
def stops_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "metrics-stream")
    log = metrics(spark, sf_dir).select("run", "epoch", "loss")
    log.repartition(8).write.parquet(f"{path}/log")
    stream = (
        spark.readStream.schema("run long, epoch long, loss double")
        .option("maxFilesPerTrigger", 4)
        .parquet(f"{path}/log")
    )
    stopped = stream_early_stop(stream, "run", PATIENCE, MIN_EPOCHS)
    write_stops(stopped, f"{path}/stops", f"{path}/checkpoint").awaitTermination()
    schema = "run long, stop_epoch long, best_epoch long, best_value double"
    return spark.read.schema(schema).parquet(f"{path}/stops")


@query(
    "prune_trials",
    f"""WITH {METRICS},
    best AS (SELECT run FROM metrics ORDER BY loss, run LIMIT 1),
    diffs AS (
      SELECT m.run AS trial, m.loss - b.loss AS d
      FROM metrics m JOIN metrics b ON b.epoch = m.epoch
      WHERE b.run = (SELECT run FROM best) AND m.run <> b.run),
    ranked AS (
      SELECT trial, d, rank() OVER (PARTITION BY trial ORDER BY abs(d))
               + (count(*) OVER (PARTITION BY trial, abs(d)) - 1) / 2 AS r,
             count(*) OVER (PARTITION BY trial, abs(d)) AS t
      FROM diffs WHERE d <> 0),
    sums AS (
      SELECT trial, count(*) AS m, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus,
             sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(t * t - 1) AS ties
      FROM ranked GROUP BY trial),
    tested AS (
      SELECT *, (w_plus - m * (m + 1) / 4)
                / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM sums)
    SELECT 'search' AS study, c.trial, c.steps, m, w_plus, w_minus, round(z, 6) AS z,
           coalesce(z > 1.2815515655446004, false) AS pruned
    FROM (SELECT trial, count(*) AS steps FROM diffs GROUP BY trial) c
    LEFT JOIN tested ON tested.trial = c.trial""",
)
def pruned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = written(
        metrics(spark, sf_dir).select(
            F.lit("search").alias("study"), F.col("run").alias("trial"), "epoch", "loss"
        ),
        "steps",
    )
    # Two trials without a single loss: they are never the best.
    nothing = F.explode(F.array(F.lit(None).cast("double"), F.lit(float("nan")))).alias("loss")
    empty = steps.select("study", F.lit(-1).cast("long").alias("trial"), "epoch", nothing)
    steps = steps.unionByName(empty)
    tested = prune_trials(steps, "study", "trial", "epoch", "loss")
    return tested.withColumn("z", F.round("z", 6))


STARTUP = 5


@query(
    "prune_running",
    f"""WITH {METRICS},
    best AS (SELECT run FROM metrics ORDER BY loss, run LIMIT 1),
    diffs AS (
      SELECT m.run AS trial, m.epoch, m.loss - b.loss AS d
      FROM metrics m JOIN metrics b ON b.epoch = m.epoch
      WHERE b.run = (SELECT run FROM best) AND m.run <> b.run),
    so_far AS (
      SELECT n.trial, n.epoch AS upon, e.d
      FROM diffs n JOIN diffs e ON e.trial = n.trial AND e.epoch <= n.epoch),
    ranked AS (
      SELECT trial, upon, d, rank() OVER (PARTITION BY trial, upon ORDER BY abs(d))
               + (count(*) OVER (PARTITION BY trial, upon, abs(d)) - 1) / 2 AS r,
             count(*) OVER (PARTITION BY trial, upon, abs(d)) AS t
      FROM so_far WHERE d <> 0),
    sums AS (
      SELECT trial, upon, count(*) AS m, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus,
             sum(t * t - 1) AS ties
      FROM ranked GROUP BY trial, upon),
    tested AS (
      SELECT trial, upon, (w_plus - m * (m + 1) / 4)
                / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM sums),
    counted AS (SELECT trial, upon, count(*) AS steps FROM so_far GROUP BY trial, upon),
    spoken AS (
      SELECT trial, min(upon) AS pruned_at, arg_min(steps, upon) AS steps, arg_min(z, upon) AS z
      FROM counted JOIN tested USING (trial, upon)
      WHERE z > 1.2815515655446004 AND steps >= {STARTUP} GROUP BY trial)
    SELECT 'search' AS study, d.trial, pruned_at, steps, round(z, 6) AS z
    FROM (SELECT DISTINCT trial FROM diffs) d LEFT JOIN spoken ON spoken.trial = d.trial""",
)
def runs_pruned_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = written(
        metrics(spark, sf_dir).select(
            F.lit("search").alias("study"), F.col("run").alias("trial"), "epoch", "loss"
        ),
        "steps",
    )
    found = prune_running(steps, "study", "trial", "epoch", "loss", STARTUP)
    return found.withColumn("z", F.round("z", 6))


LR = f"""exp(ln(1e-9) + (('0x' || substr(md5('{SEED}:lr:' || o_orderkey), 1, 8))::BIGINT
  / 4294967296.0::DOUBLE) * (ln(1e-3) - ln(1e-9)))"""
KLW = f"""exp(ln(1.0) + (('0x' || substr(md5('{SEED}:kl_weight:' || o_orderkey), 1, 8))::BIGINT
  / 4294967296.0::DOUBLE) * (ln(5000.0) - ln(1.0)))"""


def order_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials: the priority is the study, the price is the value.

    Every ninth trial has no value yet.
    """
    unfinished = F.col("o_orderkey") % 9 == 0
    trials = read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("study"),
        F.col("o_orderkey").alias("trial"),
        F.when(~unfinished, F.col("o_totalprice")).alias("value"),
    )
    return with_log_uniform(trials, "trial", RANGES, SEED)


@query(
    "log_uniform_trials",
    f"""SELECT o_orderpriority AS study, o_orderkey AS trial, round(log10({LR}), 6) AS log_lr,
           round({KLW}, 4) AS kl_weight FROM orders""",
)
def drawn_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_trials(spark, sf_dir).select(
        "study",
        "trial",
        F.round(F.log10("lr"), 6).alias("log_lr"),
        F.round("kl_weight", 4).alias("kl_weight"),
    )


@query(
    "range_scores",
    f"""WITH trials AS (
      SELECT o_orderpriority AS study, floor(log10({LR}))::BIGINT AS bin,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)
               <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.25) AS good
      FROM orders WHERE o_orderkey % 9 <> 0),
    bins AS (SELECT study, bin, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad
             FROM trials GROUP BY study, bin)
    SELECT study, bin, good, bad,
           round(((good + 1) / (sum(good) OVER w + count(*) OVER w))
                 / ((bad + 1) / (sum(bad) OVER w + count(*) OVER w)), 6) AS score
    FROM bins WINDOW w AS (PARTITION BY study)""",
)
def scored_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = range_scores(order_trials(spark, sf_dir), "study", "trial", "value", "lr")
    return scores.withColumn("score", F.round("score", 6))


DRAWS, KEPT = 400, 50


def sql_bins(name: str, value: str) -> str:
    """Bins of one setting with their range of draws and their density ratio."""
    return f"""{name}_counts AS (
      SELECT study, floor(log10({value}))::BIGINT AS bin, count(*) FILTER (good) AS good,
             count(*) FILTER (NOT good) AS bad
      FROM trials GROUP BY ALL),
    {name}_bins AS (
      SELECT study, bin, sum(good + 1) OVER (PARTITION BY study ORDER BY bin) AS upto, good + 1 AS width,
             sum(good + 1) OVER w AS whole,
             ((good + 1) / (sum(good) OVER w + count(*) OVER w))
               / ((bad + 1) / (sum(bad) OVER w + count(*) OVER w)) AS score
      FROM {name}_counts WINDOW w AS (PARTITION BY study)),
    {name}_drawn AS (
      SELECT d.study, d.draw, b.bin, b.score,
             ('0x' || substr(md5('{SEED}:{name}:place:' || d.study || ':' || d.draw), 1, 8))::BIGINT
               / 4294967296.0::DOUBLE AS place
      FROM draws d JOIN {name}_bins b ON b.study = d.study
        AND ('0x' || substr(md5('{SEED}:{name}:bin:' || d.study || ':' || d.draw), 1, 8))::BIGINT::HUGEINT
              * b.whole BETWEEN (b.upto - b.width) * 4294967296::HUGEINT AND b.upto * 4294967296::HUGEINT - 1)"""


@query(
    "propose_trials",
    f"""WITH trials AS (
      SELECT o_orderpriority AS study, {LR} AS lr, {KLW} AS kl_weight,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)
               <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.25) AS good
      FROM orders WHERE o_orderkey % 9 <> 0),
    draws AS (SELECT study, draw FROM (SELECT DISTINCT study FROM trials) CROSS JOIN range({DRAWS}) AS r(draw)),
    {sql_bins("lr", "lr")},
    {sql_bins("kl_weight", "kl_weight")},
    ranked AS (
      SELECT study, draw, a.score * b.score AS score, a.bin AS a_bin, a.place AS a_place,
             b.bin AS b_bin, b.place AS b_place,
             row_number() OVER (PARTITION BY study ORDER BY a.score * b.score DESC, draw) AS place
      FROM lr_drawn a JOIN kl_weight_drawn b USING (study, draw))
    SELECT study, place, draw::INTEGER AS draw, round(score, 6) AS score,
           round(greatest(a_bin, -9) + a_place * (least(a_bin + 1, -3) - greatest(a_bin, -9)), 6) AS log_lr,
           round(greatest(b_bin, 0) + b_place * (least(b_bin + 1, log10(5000)) - greatest(b_bin, 0)), 6)
             AS log_kl_weight
    FROM ranked WHERE place <= {KEPT}""",
)
def proposed_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = order_trials(spark, sf_dir)
    found = propose_trials(trials, "study", "trial", "value", RANGES, DRAWS, KEPT, SEED)
    logs = [F.round(F.log10(name), 6).alias(f"log_{name}") for name in RANGES]
    return found.select("study", "place", "draw", F.round("score", 6).alias("score"), *logs)
