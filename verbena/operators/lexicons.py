"""Word lists: the given ones, their union and overlap, and their cover of a corpus."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.functions.text import is_one_of, tokens_of

# The word lists to mask, by task and by filler set.
WORD_LISTS = {
    "own_dr": "man boy woman girl water milk wine beer",
    "own_bv": "barn building house hotel bicycle bus car tank",
    "own_wr": "milk snow egg sheep blood cherry tomato fire",
    "filler_1": "teenager dog cat gentleman friend worker jar glass dish mirror window camera",
    "filler_2": "customer guest manager farmer doctor artist snack tape phone grain medicine hammer",
    "filler_3": "man boy woman girl person customer water milk beer coffee tea",
    "filler_4": "person guest child customer patient king pizza orange snack bread sandwich cake",
    "filler_5": "journalist editor student scientist child actor book article document script story magazine",
    "filler_6": "prince president client author committee representative choice error decision statement purchase incident",
}
LEXICONS = {name: words.split() for name, words in WORD_LISTS.items()}


def distinct_words(lexicons: dict[str, list[str]], names: list[str] | None = None) -> list[str]:
    """The words of the named lists, each once."""
    return sorted({w for name in (names or list(lexicons)) for w in lexicons[name]})


def lexicon_union(lists: list[DataFrame], word: str = "word") -> DataFrame:
    """Distinct words of any number of word tables."""
    return reduce(DataFrame.union, [words.select(word) for words in lists]).distinct()


def lexicon_overlap(lists: dict[str, DataFrame], word: str = "word") -> DataFrame:
    """Words that two lists share: list_a, list_b, word.

    One shuffle notes which lists hold a word; the pairs are those of the named lists,
    known when the plan is written, not pairs found in the data.
    """
    rows = reduce(
        DataFrame.union,
        [words.select(word, F.lit(name).alias("_list")) for name, words in lists.items()],
    )
    held = rows.groupBy(word).agg(
        *[F.max(F.col("_list") == name).alias(f"_in_{name}") for name in lists]
    )
    shared = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_in_{a}") & F.col(f"_in_{b}"),
                    F.struct(F.lit(a).alias("list_a"), F.lit(b).alias("list_b")),
                )
                for a, b in combinations(sorted(lists), 2)
            ]
        )
    )
    return held.select(word, F.inline(shared)).select("list_a", "list_b", word)


def unseen_words(test: DataFrame, train: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words of ``test`` that ``train`` lacks.

    Both sides are made distinct first, map-side too; a plain ``subtract`` would send every
    occurrence of a frequent word to one task.
    """
    known = train.select(word).distinct()
    return test.select(word).distinct().join(known, word, "left_anti")


def lexicon_coverage(
    tokens: DataFrame, lexicons: dict[str, list[str]], dataset: str = "dataset"
) -> DataFrame:
    """Hits per data set, list and word, zero rows included.

    One pass over the tokens: they are counted by data set and listed word, then the
    counts of a data set, at most one per listed word, are read off by word.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("lexicon"), F.lit(w).alias("word"))
            for name, words in lexicons.items()
            for w in words
        ]
    )
    listed = is_one_of(F.col("token"), distinct_words(lexicons))
    counts = tokens.groupBy(dataset, F.when(listed, F.col("token")).alias("_word")).agg(
        F.count("*").alias("_hits")
    )
    found = F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("_word", "_hits")))
    by_word = counts.groupBy(dataset).agg(F.map_from_entries(found).alias("_found"))
    return by_word.select(dataset, "_found", F.inline(entries)).select(
        dataset,
        "lexicon",
        "word",
        F.coalesce(F.col("_found")[F.col("word")], F.lit(0)).alias("hits"),
    )


def coverage_by_dataset(
    coverage: DataFrame, datasets: list[str], dataset: str = "dataset"
) -> DataFrame:
    """Hits per list with one column per named data set."""
    return (
        coverage.groupBy("lexicon")
        .pivot(dataset, datasets)
        .agg(F.sum("hits"))
        .na.fill(0, datasets)
    )


def split_overlap(
    tokens: DataFrame, role: str = "role", train: str = "train", test: str = "test"
) -> DataFrame:
    """How much of the test text the training text has never shown."""
    counts = (
        tokens.groupBy("token")
        .agg(
            F.count_if(F.col(role) == train).alias("_train"),
            F.count_if(F.col(role) == test).alias("_test"),
        )
        .filter("_test > 0")
    )
    unseen = F.col("_train") == 0
    return counts.agg(
        F.sum("_test").alias("test_tokens"),
        F.sum(F.when(unseen, F.col("_test")).otherwise(0)).alias("unseen_tokens"),
        F.count("*").alias("test_types"),
        F.count_if(unseen).alias("unseen_types"),
    ).select(
        "*",
        (F.col("unseen_tokens") / F.col("test_tokens")).alias("unseen_token_share"),
        (F.col("unseen_types") / F.col("test_types")).alias("unseen_type_share"),
    )


def lines_with_lexicon(df: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Rows whose text holds a listed word."""
    return df.filter(F.arrays_overlap(tokens_of(text), F.lit(sorted(set(words)))))


def lines_without_lexicon(df: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Rows whose text holds none of the listed words."""
    held = F.arrays_overlap(tokens_of(text), F.lit(sorted(set(words))))
    return df.filter(~F.coalesce(held, F.lit(False)))
