"""Run options as long tables: dotted keys, types and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.functions.options import DELETE, unquoted, value_kind
from verbena.session import written


def flatten_options(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """One row per leaf of a JSON object: keys, key (dotted path), value (text).

    Objects are opened level by level until none is left, however deep they go; a level is
    written, as the next one reads it twice. An object is told from a string that looks like one
    by its type. An empty object is the leaf ``{}``. A payload that is null or no object is kept
    whole, as the value of a row without a key.
    """
    here = F.col("value")

    def opened(prefix: Column) -> Column:
        texts = F.from_json(here, "map<string,string>")
        kinds = F.from_json(here, "map<string,variant>")
        return F.transform(
            F.map_entries(texts),
            lambda e: F.struct(
                F.concat(prefix, e["key"]).alias("key"),
                e["value"].alias("value"),
                F.coalesce(
                    F.schema_of_variant(F.element_at(kinds, e["key"])).startswith("OBJECT<")
                    & (F.regexp_replace(e["value"], r"\s", "") != "{}"),
                    F.lit(False),
                ).alias("open"),
            ),
        )

    whole = df.select(*keys, F.lit(None).cast("string").alias("key"), F.col(payload).alias("value"))
    good = F.from_json(here, "map<string,string>").isNotNull()
    leaves = whole.filter(~F.coalesce(good, F.lit(False)))
    level = written(
        whole.filter(good).select(*keys, F.inline(opened(F.lit("")))), "options"
    )
    while True:
        leaves = leaves.unionByName(level.filter(~F.col("open")).drop("open"))
        inner = level.filter("open")
        if inner.isEmpty():
            return leaves
        prefix = F.concat(F.col("key"), F.lit("."))
        level = written(inner.select(*keys, F.inline(opened(prefix))), "options")


def json_text(value: Column) -> Column:
    """The JSON text of a string: taken out of {"v":"..."}; a missing value is null."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "null").otherwise(
        F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1)
    )


def nest_options(options: DataFrame, keys: list[str], text: str = "options") -> DataFrame:
    """The reverse: one JSON object per run, its fields in the order of their names.

    With a ``pos`` column, a key with several values becomes a list; without one, a key
    must be unique in its run. The deepest fields are folded into their parent first, and a leaf
    takes part from its own depth up. The rows of a run meet in one task once, and what is gathered
    at once is the values of one key or the fields of one object. Rows without a key are left out. A key that has a value and
    fields as well is an error.
    """
    rows = options.filter("key IS NOT NULL").withColumn("_json", json_text(F.col("value")))
    if "pos" in options.columns:
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "_json"))), lambda e: e["_json"]
        )
        listed = F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
        rows = rows.groupBy(*keys, "key").agg(
            F.when(F.count("*") == 1, F.max("_json")).otherwise(listed).alias("_json")
        )
    rows = written(rows.select(*keys, F.split("key", r"\.").alias("_path"), "_json"), "leaves")
    longest = rows.agg(F.max(F.size("_path"))).first()[0] or 0
    # Each leaf moves once, to its run; the groups of every depth are parts of a run.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clash = F.concat(F.lit("an option has a value and fields: "), F.array_join("_path", "."))

    def leaves(depth: int) -> DataFrame:
        own = rows.filter(F.size("_path") == depth).repartition(parts, *keys)
        return own.select(*keys, "_path", "_json", F.lit(False).alias("_object"))

    nested = None
    for depth in range(longest, 0, -1):
        here = leaves(depth)
        if nested is not None:
            here = (
                here.unionByName(nested.withColumn("_object", F.lit(True)))
                .groupBy(*keys, "_path")
                .agg(F.max("_json").alias("_json"), F.count_if("_object").alias("_objects"), F.count("*").alias("_n"))
                .withColumn(
                    "_json",
                    F.when(F.col("_objects") % F.col("_n") == 0, F.col("_json")).otherwise(
                        F.raise_error(clash).cast("string")
                    ),
                )
            )
        field = F.concat(json_text(F.element_at("_path", F.lit(depth))), F.lit(":"), F.col("_json"))
        nested = (
            here.groupBy(*keys, F.slice("_path", 1, depth - 1).alias("_path"))
            .agg(F.array_sort(F.collect_list(field)).alias("_fields"))
            .select(
                *keys,
                "_path",
                F.concat(F.lit("{"), F.array_join("_fields", ","), F.lit("}")).alias("_json"),
            )
        )
    if nested is None:
        return rows.select(*keys, F.col("_json").alias(text))
    return nested.select(*keys, F.col("_json").alias(text))


def coerce_option(options: DataFrame, value: str = "value") -> DataFrame:
    """Add kind and the typed value: as_boolean, as_integer, as_decimal, as_text."""
    plain = F.col("_plain")
    kind = F.col("kind")
    typed = options.withColumn("_plain", unquoted(F.col(value))).withColumn(
        "kind", value_kind(F.col(value), plain)
    )
    return typed.select(
        *options.columns,
        "kind",
        F.when(kind == "flag", True).when(kind == "boolean", plain == "True").alias("as_boolean"),
        F.when(kind == "integer", plain.try_cast("bigint")).alias("as_integer"),
        F.when(kind.isin("integer", "decimal"), plain.try_cast("double")).alias("as_decimal"),
        F.when(kind == "text", plain).alias("as_text"),
    )


def apply_overrides(
    runs: DataFrame,
    given: DataFrame,
    defaults: dict[str, str],
    run: str,
    key: str = "key",
    value: str = "value",
    pos: str = "pos",
) -> DataFrame:
    """Options of each run as run, pos, key, value: the given ones, then the defaults.

    ``runs`` names all runs, so one to which nothing is given has the defaults. A default
    holds where nothing was given for its key. The delete mark takes the key out, default and
    all. ``pos`` is the place in a list of values; defaults, and values without one, have 0.
    """
    filled = runs.select(run).distinct().select(
        run,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias(key), F.lit(v).alias(value))
                    for k, v in defaults.items()
                ]
            )
        ),
    )
    left_over = filled.join(given.select(run, key).distinct(), [run, key], "left_anti")
    kept = given.filter(~F.col(value).eqNullSafe(F.lit(DELETE)))
    place = F.coalesce(F.col(pos).cast("int"), F.lit(0)) if pos in given.columns else F.lit(0)
    return kept.select(run, place.alias(pos), key, value).unionByName(
        left_over.select(run, F.lit(0).alias(pos), key, value)
    )
