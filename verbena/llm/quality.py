"""Line-first quality rules (native): judge each line, drop failures, then judge what is left.

Defined cases. A null text is the empty text: no words, so the base rule fails it. Lines are what
``\\n`` separates; a line without a word is neither good nor bad and stays where it is. Repeated
rows are judged one by one and so alike. Nothing is joined or shuffled, so null keys, ties and
further columns play no part.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.llm.support import WORD, let, spare, text_of, words_of

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
LEAST_KEPT = 50  # per cent of the characters of all lines with a word
SYMBOLS = "[#*$%&|<>]"

# Line rules. Patterns are read alike by Java and RE2.
TAIL = 4  # an end mark and up to three closing marks
END_MARK = r"[.!?…:;。！？][\])}\"'’”»]{0,3}$"
SENTENCE = r"[.!?…。！？][\])}\"'’”»]{0,3}[\x20\x09]"
BLANKS = " \t\r\x0b\x0c"
MENU = r"[\x20\x09][|»›•·>][\x20\x09][^|»›•·>]*[\x20\x09][|»›•·>]([\x20\x09]|$)"
SHOUT = r"!!.*!!.*!!"
# Phrases of page furniture, looked for in small letters and with a capital first letter.
BOILERPLATE = [
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "subscribe to our",
    "terms of use",
]
MOST_SYMBOLS = 10  # per cent of the characters of a line


COLUMNS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "kept",
    "n_bad_lines",
]


def symbols_in(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words: of pairs, of pairs of pairs, and one more."""

    def joined(left: Column, right: Column, shift: int) -> Column:
        shifted = F.slice(right, shift + 1, F.size(right))
        return F.zip_with(left, shifted, lambda a, b: F.xxhash64(a, b))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    fives = let(
        ones,
        lambda h: let(
            joined(h, h, 1),
            lambda two: let(joined(two, two, 2), lambda four: joined(four, h, 4)),
        ),
    )
    full = F.slice(fives, 1, F.size(words) - (WINDOW - 1))
    return F.when(F.size(words) >= WINDOW, full).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of five that the text holds twice or more.

    If all hashes differ there is none; else they are sorted with their places, and the places of
    equal neighbours are merged into covered words.
    """

    def places(r: Column) -> Column:
        twice = F.filter(
            r,
            lambda x, j: F.coalesce(F.get(r, j + 1)["h"] == x["h"], F.lit(False))
            | ((j > 0) & (F.get(r, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = let(
        ranked,
        lambda r: F.aggregate(
            places(r),
            nothing,
            lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        ),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def boilerplate_in(text: Column, skip: int = 0) -> Column:
    """Whether a phrase is in the text; ``skip`` leaves out its first letters."""
    return reduce(or_, [F.contains(text, F.lit(x[skip:])) for x in BOILERPLATE])


def line_fails(line: Column, symbols: Column, boilerplate: Column) -> Column:
    """Whether a line is no prose: no end mark, a menu, shouting, symbols or boilerplate.

    A line that breaks off after a whole sentence is prose.
    ``symbols`` and ``boilerplate`` say whether the text has any, which spares most lines a look.
    """
    return (
        (
            ~F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(TAIL)).rlike(END_MARK)
            & ~line.rlike(SENTENCE)
        )
        | line.rlike(MENU)
        | line.rlike(SHOUT)
        | (symbols & (symbols_in(line) * 100 > F.length(line) * MOST_SYMBOLS))
        | (boilerplate & let(F.lower(line), lambda low: boilerplate_in(low)))
    )


def quality_rules(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` and a struct column of counts, the cleaned text and the verdict.

    ``out`` gets a spare name if a column has it. The steps are projections of their own, so that
    each array is made once and what can be compiled is.
    """
    out = spare(docs, out)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    value = F.col("value")
    first = docs.select(F.struct(*columns).alias("row"), text_of(text).alias("value")).select(
        "row",
        "value",
        words_of(value).alias("words"),
        F.split(value, "\n", -1).alias("lines"),
        symbols_in(value).alias("n_symbols"),
        boilerplate_in(value, skip=1).alias("phrase"),
    )
    second = first.select(
        "row",
        "words",
        "lines",
        "n_symbols",
        window_hashes(F.col("words")).alias("hashes"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("full"),
        F.filter(
            "lines", lambda x: ~x.rlike(WORD) | ~line_fails(x, F.col("n_symbols") > 0, F.col("phrase"))
        ).alias("good"),
    )
    # One row explodes to one: a filter on the verdict is not moved below this step, where it would
    # evaluate all of the above once more for each use.
    counted = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size("full").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_bad_lines"),
        # A cleaned text keeps its blank lines; only lines with a word count as text.
        F.array_join("good", "\n").alias("clean_text"),
        F.length(F.array_join(F.filter("good", lambda x: x.rlike(WORD)), "")).alias("stay"),
        F.length(F.array_join("full", "")).alias("whole"),
    )
    third = second.select("row", F.inline(F.array(counted)))
    base = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    )
    judged = third.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.col("stay") * 100 >= F.col("whole") * LEAST_KEPT)
    )
    return judged.select(
        *[F.col("row")[c].alias(c) for c in docs.columns],
        F.struct(*COLUMNS, "n_lines", "clean_text").alias(out),
    )


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that pass, without their bad lines, in the columns they came with."""
    name = spare(docs, "quality")
    judged = quality_rules(docs, text, name).filter(F.col(name)["kept"])
    cleaned = judged.withColumn(text, F.col(name)["clean_text"])
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn(
            "n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)
        )
    return cleaned.drop(name)


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT rid, doc_id, text,
    list_filter(string_split_regex(text, '{_sql_text("[ \\x09-\\x0D]+")}'), lambda x: x <> '') AS words,
    string_split(text, chr(10)) AS lines,
    regexp_matches(text, '{"|".join(x[1:] for x in BOILERPLATE)}') AS phrase
  FROM d),
v AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
  FROM (SELECT rid, i, words[i:i+4] AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM p))),
r AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i, unnest(range(0, 5)) AS k FROM v WHERE c > 1) GROUP BY rid),
j AS (
  SELECT p.rid, doc_id, text, words, len(words) AS n_words, coalesce(r.n, 0) AS n_repeat_words,
    list_filter(lines, lambda x: regexp_matches(x, '{WORD}')) AS filled, len(lines) AS n_all,
    list_filter(lines, lambda x: NOT regexp_matches(x, '{WORD}') OR NOT (
      (NOT regexp_matches(right(rtrim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), {TAIL}),
                          '{_sql_text(END_MARK)}')
       AND NOT regexp_matches(x, '{_sql_text(SENTENCE)}'))
      OR regexp_matches(x, '{_sql_text(MENU)}')
      OR regexp_matches(x, '{SHOUT}')
      OR (length(x) - length(regexp_replace(x, '{SYMBOLS}', '', 'g'))) * 100
         > length(x) * {MOST_SYMBOLS}
      OR (phrase AND regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')))) AS good
  FROM p LEFT JOIN r ON p.rid = r.rid),
k AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words
    AS base_failed
  FROM j)
SELECT doc_id, n_words::BIGINT AS n_words,
  length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
  (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * length(array_to_string(
    list_filter(good, lambda x: regexp_matches(x, '{WORD}')), ''))
    >= {LEAST_KEPT} * length(array_to_string(filled, '')) AS kept,
  (n_all - len(good))::BIGINT AS n_bad_lines
FROM k"""
