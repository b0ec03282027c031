"""What each of several filters removes, in every order they can be applied in.

A row fails some of the filters; the set it fails is its mask. Applied in an order, the filters remove
it at the first step whose filter is in the mask. Orders are numbered by their Lehmer rank, which is
their lexicographic place, so all orders that begin alike are an interval of ranks. A mask is removed
at step s by the orders that begin with s - 1 filters outside it and one inside: a set of intervals
that holds for all data. So rows are only counted by part and mask; each count is added at the first
rank of its intervals and taken off after the last, and a running sum over the ranks gives the totals
of every order and step.

The rows of a text are counted by (text digest, part, id) and only then brought together by digest, so a
group of copies of any size meets as one row for each part. Digests are SHA-256; texts never move.

Defined cases of :func:`audit_filters`. A null text is the empty text, a null source the part "". A
row without an id is never a repeat and no row repeats it; rows of equal id and text don't repeat each
other. A document is good or toxic if any of its label rows says so. An empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.support import let, text_of, words_of

FEWEST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
SYMBOLS = "[#$%&*|]"
LETTERS = "ABCDE"  # A to D judge a text alone; E is a repeat of a smaller id's text

MEASURES = ["n", "good", "toxic"]


def text_mask(text: Column) -> Column:
    """Which of the filters A to D a text fails, as the bits 1, 2, 4 and 8."""

    def judged(words: Column) -> Column:
        n = F.size(words)
        distinct = F.size(F.array_distinct(words))
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        failed = [
            n < FEWEST_WORDS,
            100 * distinct < LEAST_DISTINCT * n,
            100 * capitals > MOST_CAPITALS * F.length(text),
            text.rlike(SYMBOLS),
        ]
        bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)]
        return sum(bits[1:], bits[0])

    return let(words_of(text), judged)


def lehmer_rank(prefix: tuple[int, ...], size: int) -> int:
    """The rank of the first order of ``size`` filters that begins with ``prefix``."""
    rank = 0
    for place, item in enumerate(prefix):
        smaller = item - sum(x < item for x in prefix[:place])
        rank += smaller * factorial(size - 1 - place)
    return rank


def removal_intervals(size: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of all masks of ``size`` filters.

    Neighbouring intervals of a mask and step are one.
    """
    out: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << size):
        for step in range(1, size + 1):
            width = factorial(size - step)
            runs: list[list[int]] = []
            for prefix in permutations(range(size), step):
                inside = [mask >> item & 1 for item in prefix]
                if inside[-1] and not any(inside[:-1]):
                    first = lehmer_rank(prefix, size)
                    if runs and runs[-1][1] == first:
                        runs[-1][1] += width
                    else:
                        runs.append([first, first + width])
            out += [(mask, step, first, last) for first, last in runs]
    return out


def order_names(letters: str) -> list[str]:
    """All orders of the filters by rank."""
    return ["".join(order) for order in permutations(letters)]


def audit_masks(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Totals of every part, order and step, from rows (part, mask, n, good, toxic).

    ``letters`` names the filters, the first being bit 1 of a mask, and must ascend. Rows of the same
    part and mask add up. The tables behind it have a fixed size for each part.
    """
    size, orders = len(letters), order_names(letters)
    spark = counts.sparkSession
    steps = F.sequence(F.lit(1), F.lit(size))
    fails = [F.col("mask").bitwiseAND(1 << k) != 0 for k in range(size)]
    alone = [F.col("mask") == 1 << k for k in range(size)]
    whole = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(f, F.col("n")).otherwise(0)) for f in fails]).alias("fails"),
        F.array(*[F.sum(F.when(f, F.col("n")).otherwise(0)) for f in alone]).alias("alone"),
    )
    # At most 31 masks of five filters, a constant of the method, so it may be broadcast.
    table = spark.createDataFrame(
        removal_intervals(size), "mask int, step int, start int, end int"
    )
    met = counts.join(F.broadcast(table), "mask")
    ends = F.array(
        F.struct(F.col("start").alias("rank"), *[F.col(c) for c in MEASURES]),
        F.struct(F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in MEASURES]),
    )
    changes = met.select("part", "step", F.inline(ends))
    every = whole.select(
        "part",
        F.explode(steps).alias("step"),
        *[F.lit(0).cast("long").alias(c) for c in MEASURES],
    ).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
    differences = (
        changes.unionByName(every)
        .groupBy("part", "step", "rank")
        .agg(*[F.sum(c).alias(c) for c in MEASURES])
    )
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    removed = differences.select(
        "part", "step", "rank", *[F.sum(c).over(so_far).alias(c) for c in MEASURES]
    ).filter(F.col("rank") < len(orders))
    names = F.lit(orders)
    named = removed.withColumn("filter_order", F.get(names, F.col("rank"))).withColumn(
        "letter", F.expr("substring(filter_order, step, 1)")
    )
    place = F.instr(F.lit(letters), F.col("letter")) - 1
    within = Window.partitionBy("part", "rank").orderBy("step")
    share = Window.partitionBy("part", "letter")
    full = (
        named.withColumn("gone", F.sum("n").over(within))
        .withColumn("shapley", F.sum("n").over(share))
        .join(whole, "part")
    )
    return full.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        F.col("n").alias("removed"),
        (F.get("fails", place) - F.col("n")).alias("redundant"),
        F.get("alone", place).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def mask_counts(docs: DataFrame, labels: DataFrame, mask: Column, part: Column) -> DataFrame:
    """Rows, good and toxic ones by part and mask, with the bit of E for repeated texts.

    ``mask`` holds the bits of filters that judge a text alone.
    """
    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        part.alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        mask.alias("mask"),
    )
    rows = rows.groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    n = F.col("n")
    marked = rows.join(marks, "doc_id", "left").select(
        "digest",
        "part",
        "mask",
        "doc_id",
        n,
        *[(F.coalesce(c, F.lit(0)) * n).alias(c) for c in ("good", "toxic")],
    )
    # One row for each text and part: all its rows, and those of its least id.
    known = F.col("doc_id").isNotNull()
    least = F.min(F.when(known, F.struct("doc_id", *MEASURES)))
    nameless = [F.sum(F.when(known, 0).otherwise(F.col(c))).alias(f"free_{c}") for c in MEASURES]
    texts = marked.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in MEASURES], *nameless, least.alias("head")
    )
    first = F.min("head.doc_id").over(Window.partitionBy("digest"))
    heads = texts.withColumn("leads", F.coalesce(F.col("head.doc_id") == first, F.lit(False)))
    leading = {
        c: F.col(f"free_{c}") + F.when(F.col("leads"), F.col(f"head.{c}")).otherwise(0)
        for c in MEASURES
    }
    bit = 1 << LETTERS.index("E")
    both = F.array(
        F.struct(F.col("mask"), *[leading[c].alias(c) for c in MEASURES]),
        F.struct(
            F.col("mask").bitwiseOR(bit).alias("mask"),
            *[(F.col(c) - leading[c]).alias(c) for c in MEASURES],
        ),
    )
    counts = heads.select("part", F.inline(both)).filter("n > 0")
    return counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in MEASURES])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over ``docs`` (doc_id, text, source), by source."""
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return audit_masks(mask_counts(docs, labels, text_mask(text_of()), part))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
m AS (
  SELECT doc_id, part,
         (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text)
             THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN e THEN 'E' ELSE '' END) AS mask FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter
      FROM o, range(1, 6) AS r(step)),
t AS (
  SELECT part, filter_order, step, letter, n, good, toxic,
         contains(mask, letter) AS fails, mask = letter AS alone,
         regexp_matches(filter_order[1:step - 1], '[' || mask || '-]') AS before
  FROM c, s),
g AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (NOT fails AND NOT before) AS kept,
         sum(n) FILTER (fails AND NOT before) AS removed,
         sum(n) FILTER (fails AND before) AS redundant,
         sum(n) FILTER (alone) AS unique_fails,
         sum(good) FILTER (fails AND NOT before) AS good_lost,
         sum(toxic) FILTER (fails AND NOT before) AS toxic_lost
  FROM t GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM g
"""
