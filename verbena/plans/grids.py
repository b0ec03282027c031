"""Run configurations and grids of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions.options import DELETE
from verbena.operators.grid import (
    audit_runs,
    condition_cube,
    expand_grid,
    grid_counts,
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
from verbena.plans.registry import query
from verbena.plans.tables import read
from verbena.session import fresh_path, spread
from verbena.sources.results import write_results
from verbena.sources.scripts import parse_run_scripts, read_run_configs

MARGIN = ["model", "verb", "task"]


def run_name(seed: Column) -> Column:
    """Runs named after orders: <priority>-<verb of the status>-<task of the year>-<seed>."""
    return F.concat_ws(
        "-",
        F.translate(F.lower("o_orderpriority"), " ", "_"),
        F.concat(F.lit("verb"), F.lower("o_orderstatus")),
        F.when(F.year("o_orderdate") < 1995, "dr").when(F.year("o_orderdate") < 1998, "bv").otherwise("wr"),
        F.lpad(seed.cast("string"), 2, "0"),
    )


RUNS = """runs AS (
  SELECT o_orderkey, o_totalprice, translate(lower(o_orderpriority), ' ', '_') AS model,
         'verb' || lower(o_orderstatus) AS verb,
         CASE WHEN year(o_orderdate) < 1995 THEN 'dr' WHEN year(o_orderdate) < 1998 THEN 'bv'
              ELSE 'wr' END AS task,
         (o_custkey % 40)::INTEGER AS seed, o_orderstatus AS status
  FROM orders)"""


def scripts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as the job script of a run."""
    name = run_name(F.col("o_custkey") % 40)
    lines = [
        F.lit("#!/bin/bash\n\n#SBATCH --job-name="),
        F.col("name"),
        F.lit("\n\necho \"Running --this is no option\"\n\npython core/run.py \\\n"),
        F.lit("\t--model_name_or_path \"'"),
        F.translate(F.lower("o_orderpriority"), " ", "_"),
        F.lit("'\" \\\n\t--use_gpu \\\n\t--loss_classes.train losses.Default \\\n"),
        F.lit("\t\t\t\t\tlosses.Baseline \\\n\t--grad_steps 2 `# a note --not an option` \\\n"),
        F.lit("\t--kwargs.train.scaleby "),
        F.col("o_orderkey").cast("string"),
        F.lit("e-02 \\\n\t--seed "),
        F.when(F.col("o_orderstatus") == "P", 40).otherwise(F.col("o_custkey") % 40).cast("string"),
        F.lit(" \\\n\t--save_state False"),
    ]
    return (
        read(spark, sf_dir, "orders")
        .withColumn("name", name)
        .select("o_orderkey", F.col("name").alias("run_name"), F.concat(*lines).alias("text"))
    )


OPTIONS = f"""{RUNS}, options AS (
  SELECT o_orderkey, 'model_name_or_path' AS key, 0 AS pos, '"''' || model || '''"' AS value FROM runs
  UNION ALL SELECT o_orderkey, 'use_gpu', 0, NULL FROM runs
  UNION ALL SELECT o_orderkey, 'loss_classes.train', 0, 'losses.Default' FROM runs
  UNION ALL SELECT o_orderkey, 'loss_classes.train', 1, 'losses.Baseline' FROM runs
  UNION ALL SELECT o_orderkey, 'grad_steps', 0, '2' FROM runs
  UNION ALL SELECT o_orderkey, 'kwargs.train.scaleby', 0, o_orderkey || 'e-02' FROM runs
  UNION ALL SELECT o_orderkey, 'seed', 0, CASE WHEN status = 'P' THEN '40' ELSE seed::VARCHAR END FROM runs
  UNION ALL SELECT o_orderkey, 'save_state', 0, 'False' FROM runs)"""


@query("parse_run_scripts", f"WITH {OPTIONS} SELECT o_orderkey, key, pos, value FROM options")
def options_of_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_run_scripts(scripts_of_orders(spark, sf_dir), "o_orderkey")


@query(
    "read_run_configs",
    """SELECT 'part_' || p_brand AS run_id, key, pos, value FROM (
      SELECT p_brand, 'model' AS key, 0 AS pos, p_brand AS value FROM part
      UNION SELECT p_brand, 'use_gpu', 0, NULL FROM part
      UNION SELECT p_brand, 'sizes', 0, min(p_size)::VARCHAR FROM part GROUP BY p_brand
      UNION SELECT p_brand, 'sizes', 1, max(p_size)::VARCHAR FROM part GROUP BY p_brand)""",
)
def configs_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script file per brand, written by Spark and read back."""
    path = fresh_path(spark, "scripts")
    brands = read(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.min("p_size").alias("low"), F.max("p_size").alias("high")
    )
    text = F.format_string(
        "#!/bin/bash\n\npython run.py \\\n\t--model %s \\\n\t--use_gpu \\\n\t--sizes %d \\\n\t\t%d",
        "p_brand",
        "low",
        "high",
    )
    brands.select(text.alias("text"), "p_brand").write.partitionBy("p_brand").text(
        f"{path}/texts"
    )
    options = read_run_configs(spark, f"{path}/texts", "part-*", r"p_brand=([^/]+)")
    brand = F.replace(F.col("run_id"), F.lit("%23"), F.lit("#"))
    return options.withColumn("run_id", F.concat(F.lit("part_"), brand))


@query(
    "coerce_option",
    f"""WITH {OPTIONS}, plain AS (SELECT *, regexp_replace(value, '^"''|''"$', '', 'g') AS p FROM options),
    kinds AS (SELECT *, CASE WHEN value IS NULL THEN 'flag' WHEN value LIKE '"%' THEN 'text'
        WHEN value IN ('True', 'False') THEN 'boolean' WHEN key IN ('seed', 'grad_steps') THEN 'integer'
        WHEN key = 'kwargs.train.scaleby' THEN 'decimal' ELSE 'text' END AS kind FROM plain)
    SELECT o_orderkey, key, pos, value, kind,
           CASE kind WHEN 'flag' THEN true WHEN 'boolean' THEN p = 'True' END AS as_boolean,
           CASE WHEN kind = 'integer' THEN TRY_CAST(p AS BIGINT) END AS as_integer,
           CASE WHEN kind IN ('integer', 'decimal') THEN TRY_CAST(p AS DOUBLE) END AS as_decimal,
           CASE WHEN kind = 'text' THEN p END AS as_text
    FROM kinds""",
)
def typed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_option(parse_run_scripts(scripts_of_orders(spark, sf_dir), "o_orderkey"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of events, one level down in a larger object.

    Beside them stand a key of ten parts, a name that has to be escaped and a string that looks
    like an object. Every 13th payload is no JSON.
    """
    payload = F.concat(
        F.lit('{"study":{"kwargs":'),
        F.col("props"),
        F.lit('},"state":"'),
        F.col("event_type"),
        F.lit('","out":"{now}/x","a\\"b":"1","a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":"'),
        F.col("event_id"),
        F.lit('"}}}}}}}}}}'),
    )
    good = F.col("event_id") % 13 != 0
    events = spread(read(spark, sf_dir, "events").select("event_id", "event_type", "props"))
    return events.select(
        "event_id", F.when(good, payload).otherwise(F.lit("no options")).alias("payload")
    )


GOOD = "FROM events WHERE event_id % 13 <> 0"
FLAT = f"""SELECT event_id, 'study.kwargs.k' AS key, props->>'$.k' AS value {GOOD}
    UNION ALL SELECT event_id, 'state', event_type {GOOD}
    UNION ALL SELECT event_id, 'out', '{{now}}/x' {GOOD}
    UNION ALL SELECT event_id, 'a"b', '1' {GOOD}
    UNION ALL SELECT event_id, 'a.b.c.d.e.f.g.h.i.j', event_id::VARCHAR {GOOD}
    UNION ALL SELECT event_id, NULL, 'no options' FROM events WHERE event_id % 13 = 0"""


@query("flatten_options", FLAT)
def flat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_options(event_payloads(spark, sf_dir), ["event_id"], "payload")


@query(
    "nest_options",
    f"""SELECT event_id, '{{"a":{{"b":{{"c":{{"d":{{"e":{{"f":{{"g":{{"h":{{"i":{{"j":"' || event_id
             || '"}}}}}}}}}}}}}}}}}},"a\\"b":"1","out":"{{now}}/x","state":"' || event_type
             || '","study":{{"kwargs":{{"k":"' || (props->>'$.k') || '"}}}}}}' AS options {GOOD}""",
)
def nested_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_options(event_payloads(spark, sf_dir), ["event_id"], "payload")
    return nest_options(flat, ["event_id"])


DEFAULTS = {"sampler": "tpe", "patience": "30", "epochs": "1000"}


@query(
    "apply_overrides",
    """SELECT o_orderkey, 0 AS pos, 'epochs' AS key, '1000' AS value FROM orders
    UNION ALL SELECT o_orderkey, 0, 'patience',
      CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN '60' ELSE '30' END FROM orders
    UNION ALL SELECT o_orderkey, 0, 'sampler', 'tpe' FROM orders
      WHERE o_orderstatus <> 'P' OR o_orderkey % 10 = 0
    UNION ALL SELECT o_orderkey, pos, 'priority', value FROM (
      SELECT o_orderkey, 0 AS pos, o_orderpriority AS value FROM orders
      UNION ALL SELECT o_orderkey, 1, o_orderstatus FROM orders) WHERE o_orderkey % 10 <> 0""",
)
def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is given to every tenth order; the others have a list of two values."""
    status = F.col("o_orderstatus")

    def given(key: str, value: Column, pos: int = 0) -> Column:
        return F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"), value.alias("value"))

    rows = F.array(
        given("priority", F.col("o_orderpriority")),
        given("priority", F.col("o_orderstatus"), 1),
        given("sampler", F.when(status == "P", DELETE)),
        given("patience", F.when(status == "F", "60")),
    )
    options = (
        read(spark, sf_dir, "orders")
        .filter("o_orderkey % 10 <> 0")
        .select("o_orderkey", F.inline(rows))
        .filter(F.col("value").isNotNull())
    )
    return apply_overrides(read(spark, sf_dir, "orders"), options, DEFAULTS, "o_orderkey")


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model"), F.col("p_type").alias("verb"), F.col("p_size").alias("seed")
    )


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand with every type and every size that occurs."""
    cells = part_cells(spark, sf_dir)
    return expand_grid(spark, {name: cells.select(name) for name in ("model", "verb", "seed")})


PLANNED = """planned AS (
  SELECT model, verb, seed FROM (SELECT DISTINCT p_brand AS model FROM part)
  CROSS JOIN (SELECT DISTINCT p_type AS verb FROM part)
  CROSS JOIN (SELECT DISTINCT p_size AS seed FROM part))"""


@query("expand_grid", f"WITH {PLANNED} SELECT * FROM planned")
def planned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_grid(spark, sf_dir)


@query(
    "grid_gaps",
    f"WITH {PLANNED} SELECT * FROM planned EXCEPT SELECT p_brand, p_type, p_size FROM part",
)
def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_gaps(part_grid(spark, sf_dir), part_cells(spark, sf_dir), ["model", "verb", "seed"])


@query(
    "audit_runs",
    f"""WITH {RUNS} SELECT o_orderkey, 'seed' AS field, seed::VARCHAR AS in_name, '40' AS in_content
    FROM runs WHERE status = 'P'
    UNION ALL SELECT -1, 'model', 'gpt2', NULL UNION ALL SELECT -1, 'seed', '7', NULL
    UNION ALL SELECT -2, 'seed', NULL, '8'""",
)
def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = scripts_of_orders(spark, sf_dir)
    names = parse_run_name(scripts.select("o_orderkey", "run_name"), "run_name").select(
        "o_orderkey", F.col("name_model").alias("model"), F.col("name_seed").alias("seed")
    )
    options = parse_run_scripts(scripts, "o_orderkey")
    options = coerce_option(options.filter(F.col("key").isin("model_name_or_path", "seed")))
    content = options.groupBy("o_orderkey").agg(
        F.max(F.when(F.col("key") == "model_name_or_path", F.col("as_text"))).alias("model"),
        F.max(F.when(F.col("key") == "seed", F.col("as_integer"))).alias("seed"),
    )
    # One run has only a name, one only a script that states a seed.
    one = names.agg(F.count("*"))
    named = one.select(
        F.lit(-1).cast("long").alias("o_orderkey"), F.lit("gpt2").alias("model"), F.lit(7).alias("seed")
    )
    stated = one.select(
        F.lit(-2).cast("long").alias("o_orderkey"),
        F.lit(None).cast("string").alias("model"),
        F.lit(8).cast("long").alias("seed"),
    )
    names, content = names.unionByName(named), content.unionByName(stated)
    return audit_runs(names, content, "o_orderkey", ["model", "seed"])


@query(
    "grid_counts",
    f"""WITH {RUNS} SELECT model, task, count(*) AS runs, count(DISTINCT seed) AS seeds,
           min(seed) AS min_seed, max(seed) AS max_seed FROM runs GROUP BY model, task""",
)
def counted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(run_name(F.col("o_custkey") % 40).alias("run"))
    runs = parse_run_name(orders, "run")
    named = runs.select(*[F.col(f"name_{c}").alias(c) for c in ("model", "task", "seed")])
    return grid_counts(named, ["model", "task"])


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scores per order: order, score."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("item"))
        .agg(F.avg("l_extendedprice").alias("score"))
    )


@query(
    "pair_with_baseline",
    """WITH scores AS (SELECT l_orderkey AS item, avg(l_extendedprice) AS score FROM lineitem GROUP BY 1)
    SELECT item, round(score, 6) AS score, o_totalprice AS base_score,
           round(score - o_totalprice, 6) AS delta
    FROM scores LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = item""",
)
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score")
    )
    pairs = pair_with_baseline(order_scores(spark, sf_dir), base, ["item"])
    return pairs.withColumn("score", F.round("score", 6)).withColumn("delta", F.round("delta", 6))


SCORES = """scores AS (
  SELECT l_returnflag AS model, l_linestatus AS verb,
         CASE WHEN l_quantity < 25 THEN 'dr' ELSE 'wr' END AS task, l_linenumber AS seed,
         avg(l_extendedprice * (1 - l_discount)) AS score
  FROM lineitem GROUP BY ALL)"""


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as run scores: model, verb, task, seed, score."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("model"),
            F.col("l_linestatus").alias("verb"),
            F.when(F.col("l_quantity") < 25, "dr").otherwise("wr").alias("task"),
            F.col("l_linenumber").alias("seed"),
        )
        .agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"))
    )


@query(
    "seed_summary",
    f"""WITH {SCORES} SELECT model, verb, task, count(score) AS n, round(avg(score), 4) AS mean,
           round(stddev_samp(score), 4) AS sd, round(stddev_samp(score) / sqrt(count(score)), 4) AS se
    FROM scores GROUP BY model, verb, task""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = seed_summary(run_scores(spark, sf_dir), MARGIN)
    return cells.select(*MARGIN, "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "se")])


def sql_margins(how: str) -> str:
    return f"""WITH {SCORES} SELECT model, verb, task, grouping(model, verb, task) AS level,
           count(*) AS n, round(avg(score), 4) AS mean
    FROM scores GROUP BY {how} (model, verb, task)"""


@query("condition_cube", sql_margins("CUBE"))
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    margins = condition_cube(run_scores(spark, sf_dir), MARGIN)
    return margins.withColumn("mean", F.round("mean", 4))


@query("condition_rollup", sql_margins("ROLLUP"))
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    margins = condition_cube(run_scores(spark, sf_dir), MARGIN, rollup=True)
    return margins.withColumn("mean", F.round("mean", 4))


@query(
    "write_results",
    f"""WITH {RUNS} SELECT task AS dataset, model, '2024-01-01T00-00-00' AS run_ts, o_orderkey AS item,
           o_totalprice AS score FROM runs""",
)
def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are written twice under the same run time; the second write replaces the first."""
    path = fresh_path(spark, "results")
    orders = read(spark, sf_dir, "orders")
    runs = parse_run_name(
        orders.select(
            F.col("o_orderkey").alias("item"),
            F.col("o_totalprice").alias("score"),
            run_name(F.col("o_custkey") % 40).alias("run"),
        ),
        "run",
    )
    scores = runs.select(
        F.col("name_task").alias("dataset"), F.col("name_model").alias("model"), "item", "score"
    )
    for _ in range(2):
        write_results(scores, path, "2024-01-01T00-00-00")
    return spark.read.parquet(path)
