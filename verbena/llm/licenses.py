"""License scans by sparse TF-IDF cosine, with inheritance from the nearest directory (native).

A header is a run of neighbouring lines that each hold a licence word. Every distinct header is a
sparse vector of its words' TF-IDF weights; so is the whole of a file that is named like a licence
file. Cosines with the templates come from a join on the words they share and a sum. The
inverse document frequencies are counted over all headers and the templates. A header takes the
template with the largest cosine if that reaches ``LEAST``.

A file without a licence of its own inherits that of the nearest directory above it (its own folder
first) that holds a licence file: a join of each directory's ancestors with the directories of
licence files.

Only distinct headers and distinct directories are joined; templates are a fixed list, so they may
be broadcast. No two files are ever compared.

Defined cases. A null text is the empty text: no header. A null path has no directory, inherits
nothing and is no licence file. Ties go to the template first in the alphabet; a directory with
several licence files passes on the one whose path is smallest. Repeated rows are looked at one by
one. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.support import text_of
from verbena.session import written

LEAST = 0.55
HINT = (
    r"[Ll]icen[cs]e|LICEN[CS]E|[Cc]opyright|SPDX|[Pp]ermission is hereby|[Rr]edistribution and use"
    r"|[Pp]ublic domain|WARRANT|[Ww]arrant(y|ies)"
)
FILE = r"^(LICEN[CS]E|COPYING|UNLICENSE|NOTICE)([.-].*)?$"

# Notices of well-known licences, as they are commonly put (fixed values).
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use are permitted under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def terms(text: Column) -> Column:
    """Words of letters, digits, and dots or hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def headers(text: Column) -> Column:
    """Runs of neighbouring lines with a licence word, each as one string."""
    lines = F.split(text, "\n", -1)
    # Other lines become empty; runs are what stands between them.
    marked = F.transform(lines, lambda x: F.when(x.rlike(HINT), x).otherwise(F.lit("")))
    runs = F.split(F.array_join(marked, "\n"), "\n{2,}", -1)
    trimmed = F.transform(runs, lambda x: F.regexp_replace(x, "^\n+|\n+$", ""))
    found = F.array_distinct(F.array_remove(trimmed, ""))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def weighted(passages: DataFrame, frequency: DataFrame, total: Column) -> DataFrame:
    """``id, term, weight``: unit vectors of TF-IDF weights. ``passages``: id, term (repeated)."""
    counts = passages.groupBy("id", "term").agg(F.count("*").alias("tf"))
    raw = counts.join(frequency, "term").select(
        "id", "term", (F.col("tf") * (F.log((total + 1) / (F.col("df") + 1)) + 1)).alias("w")
    )
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def matched(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """``id, license, score`` of the best template of each distinct passage (id, header)."""
    own = texts.select("id", F.explode(terms(F.col("header"))).alias("term"))
    given = templates.select(
        F.col("license").alias("id"), F.explode(terms(F.col("notice"))).alias("term")
    )
    every = own.select(F.concat(F.lit("h:"), "id").alias("id"), "term").unionByName(
        given.select(F.concat(F.lit("t:"), "id").alias("id"), "term")
    )
    frequency = every.distinct().groupBy("term").agg(F.count("*").alias("df"))
    total = texts.count() + templates.count()
    frequency = written(frequency, "terms")
    left = weighted(own, frequency, F.lit(total))
    right = weighted(given, frequency, F.lit(total)).withColumnRenamed("id", "license")
    cosine = (
        left.join(right.withColumnRenamed("weight", "other"), "term")
        .groupBy("id", "license")
        .agg(F.round(F.sum(F.col("weight") * F.col("other")), 6).alias("score"))
    )
    order = Window.partitionBy("id").orderBy(F.desc("score"), "license")
    return (
        cosine.withColumn("place", F.row_number().over(order))
        .filter((F.col("place") == 1) & (F.col("score") >= LEAST))
        .drop("place")
    )


def directory_of(path: Column) -> Column:
    """The path up to its last slash; the top is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(
        F.when(path.isNotNull(), F.lit(""))
    )


def ancestors(directory: Column) -> Column:
    """A directory and all above it with their depths; the top is the empty string."""
    parts = F.split(directory, "/", -1)
    depth = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(
        F.sequence(F.lit(0), depth),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")),
    )


def scan_licenses(files: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, path, license, score, origin`` of every file (doc_id, path, text).

    ``origin`` is own, inherited or none; the score of an inherited licence is the licence file's.
    """
    path = F.col("path")
    name = F.regexp_replace(path, "^.*/", "")
    whole = F.coalesce(name.rlike(FILE), F.lit(False))
    value = text_of(text)
    every = F.when(whole & (value != ""), F.array(value)).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(headers(value), every))
    rows = written(
        files.select("doc_id", "path", whole.alias("is_file"), found.alias("headers")), "headers"
    )
    texts = written(
        rows.select(F.explode("headers").alias("header"))
        .distinct()
        .select(F.md5("header").alias("id"), "header"),
        "passages",
    )
    best = written(matched(texts, templates), "matches")
    # A row is known by its path and id; equal ones share their result.
    single = rows.select(
        "doc_id", "path", "is_file", F.transform("headers", lambda h: F.md5(h)).alias("ids")
    )
    some = (
        single.filter(F.size("ids") > 0)
        .select(F.explode(F.array_distinct("ids")).alias("id"), F.col("ids"))
        .distinct()
        .join(best, "id")
        .groupBy("ids")
        .agg(F.min(F.struct((-F.col("score")).alias("cost"), "license")).alias("best"))
        .select("ids", F.col("best.license").alias("license"), (-F.col("best.cost")).alias("score"))
    )
    with_header = single.filter(F.size("ids") > 0).join(some, "ids", "left")
    without = single.filter(F.size("ids") == 0).select(
        "*", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("score")
    )
    own = written(with_header.select(*without.columns).unionByName(without).drop("ids"), "own")
    folder = directory_of(path)
    holders = (
        own.filter(F.col("is_file") & F.col("license").isNotNull())
        .groupBy(folder.alias("above"))
        .agg(F.min(F.struct("path", "license", "score")).alias("given"))
    )
    folders = own.filter("license IS NULL").select(folder.alias("folder")).distinct()
    inherited = (
        folders.filter("folder IS NOT NULL")
        .select("folder", F.explode(ancestors(F.col("folder"))).alias("a"))
        .select("folder", F.col("a.depth").alias("depth"), F.col("a.above").alias("above"))
        .join(holders, "above")
        .groupBy("folder")
        .agg(F.max_by("given", "depth").alias("given"))
    )
    known = own.filter("license IS NOT NULL").select(
        "doc_id", "path", "license", "score", F.lit("own").alias("origin")
    )
    rest = (
        own.filter("license IS NULL")
        .select("doc_id", "path", folder.alias("folder"))
        .join(inherited, "folder", "left")
        .select(
            "doc_id",
            "path",
            F.col("given.license").alias("license"),
            F.col("given.score").alias("score"),
            F.when(F.col("given").isNull(), "none").otherwise("inherited").alias("origin"),
        )
    )
    return known.unionByName(rest)


def templates_of(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, notice string")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: folders are the source and blocks of ids.

    The documents have no paths. One that holds a licence notice plays a licence file of its folder;
    the others are text files.
    """
    notice = text_of().rlike(HINT)
    name = F.when(notice, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(
        F.concat("doc_id", F.lit(".txt"))
    )
    block = lambda size: F.floor(F.col("doc_id") / size).cast("string")
    path = F.concat_ws("/", "source", block(4096), block(64), name)
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
