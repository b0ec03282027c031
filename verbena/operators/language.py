"""Count-based language models: fit, adapt, score, and the losses.

A model is a count table with one count column per part (``n_train``, ``n_base``,
``n_test`` ...), so that several corpora share one vocabulary and one shuffle.
Counts add up: a saved table joins new text by ``merged_counts``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.functions.text import MASK, is_one_of
from verbena.operators.joins import lookup, lookups
from verbena.session import written

START = ""  # stands before the first token; no token is empty
MU = 10.0


def pair_counts(near: DataFrame, part: str, parts: list[str]) -> DataFrame:
    """Counts of (prev, token) per part, from the rows of ``neighbours``.

    The two words move as one string, with the length of the first before them: that is a quarter less to shuffle.
    """
    first = F.coalesce("prev", F.lit(START))
    counts = (
        near.select(F.concat(F.length(first).cast("string"), F.lit(" "), first, "token").alias("_pair"), part)
        .groupBy("_pair")
        .agg(*[F.count_if(F.col(part) == p).alias(f"n_{p}") for p in parts])
    )
    size = F.substring_index("_pair", " ", 1)
    start, length = F.length(size) + 2, size.cast("int")
    return counts.select(
        F.substring("_pair", start, length).alias("prev"),
        F.substring("_pair", start + length, F.length("_pair")).alias("token"),
        *counts.columns[1:],
    )


def token_counts(tokens: DataFrame, part: str, parts: list[str]) -> DataFrame:
    """Counts of each token per part."""
    return tokens.groupBy("token").agg(
        *[F.count_if(F.col(part) == p).alias(f"n_{p}") for p in parts]
    )


def merged_counts(tables: list[DataFrame], on: list[str], parts: list[str]) -> DataFrame:
    """Add count tables up, a missing part counting as zero."""
    full = [
        table.select(
            *on,
            *[
                F.col(f"n_{p}") if f"n_{p}" in table.columns else F.lit(0).alias(f"n_{p}")
                for p in parts
            ],
        )
        for table in tables
    ]
    return (
        reduce(DataFrame.union, full)
        .groupBy(*on)
        .agg(*[F.sum(f"n_{p}").alias(f"n_{p}") for p in parts])
    )


def with_words(counts: DataFrame, words: list[str], parts: list[str]) -> DataFrame:
    """Token counts with some words added to the vocabulary, seen or not."""
    extra = counts.sparkSession.range(1).select(F.explode(F.lit(words)).alias("token"))
    return merged_counts([counts, extra], ["token"], parts)


def words_of_pairs(pairs: DataFrame, parts: list[str]) -> DataFrame:
    """Token counts out of pair counts: every token is the second of just one pair."""
    return pairs.groupBy("token").agg(*[F.sum(f"n_{p}").alias(f"n_{p}") for p in parts])


def contexts_of_pairs(pairs: DataFrame, parts: list[str]) -> DataFrame:
    """How often a word stands before another: prev, context_<part>."""
    return (
        pairs.filter(F.col("prev") != START)
        .groupBy("prev")
        .agg(*[F.sum(f"n_{p}").alias(f"context_{p}") for p in parts])
    )


def fit_unigram(counts: DataFrame, parts: list[str]) -> DataFrame:
    """Add p_<part>: add-one probabilities over the vocabulary all parts share."""
    totals = counts.agg(
        F.count("*").alias("types"), *[F.sum(f"n_{p}").alias(f"n_{p}") for p in parts]
    )
    whole = totals.select(F.struct("*")).scalar()
    return counts.select(
        "*",
        *[
            (
                (F.col(f"n_{p}") + 1)
                / (whole.getField(f"n_{p}") + whole.getField("types"))
            ).alias(f"p_{p}")
            for p in parts
        ],
    )


def fit_bigram(
    pairs: DataFrame,
    words: DataFrame,
    contexts: DataFrame,
    parts: list[str],
    mu: float = MU,
) -> DataFrame:
    """Add p_<part>: the chance of ``token`` after ``prev``, smoothed towards the unigram.

    A pair a part has not seen falls back on its unigram, as the count is zero. Frequent
    words stand in very many pairs, hence the lookups that split hot keys; no word stands in more
    pairs than it was counted. ``pairs``, ``words`` and ``contexts`` should be written tables.
    """

    def counted(table: DataFrame, mark: str) -> Column:
        """The sum of all counts of a word."""
        counts = [F.col(c) for c in table.columns if c.startswith(mark)]
        return reduce(lambda x, y: x + y, counts).alias("_degree")

    values = [F.col(f"p_{p}").alias(f"_p_{p}") for p in parts]
    unigrams = words.select("token", *values, counted(words, "n_"))
    leaders = contexts.select(
        F.col("prev").alias("_leader"),
        *[f"context_{p}" for p in parts],
        counted(contexts, "context_"),
    )
    started = pairs.withColumn("_leader", F.when(F.col("prev") != START, F.col("prev")))
    both = lookups(
        started,
        [(leaders, ["_leader"], "_degree"), (unigrams, ["token"], "_degree")],
        ["prev", "token"],
    )
    inner = F.col("_leader").isNotNull()
    return both.select(
        *pairs.columns,
        *[
            (
                (F.when(inner, F.col(f"n_{p}")).otherwise(0) + mu * F.col(f"_p_{p}"))
                / (F.coalesce(f"context_{p}", F.lit(0)) + mu)
            ).alias(f"p_{p}")
            for p in parts
        ],
    )


def blended(train: Column, base: Column, weight: float) -> Column:
    """The distribution that is best for ``train`` under a KL pull towards ``base``.

    It minimises cross entropy plus ``weight`` times KL(base, model).
    """
    return (train + F.lit(float(weight)) * base) / (1 + float(weight))


def adapt_lm(
    model: DataFrame, weight: float, train: str = "p_train", base: str = "p_base"
) -> DataFrame:
    """Add p_model: the training part held near the base part."""
    return model.withColumn("p_model", blended(F.col(train), F.col(base), weight))


def score_tokens(near: DataFrame, scored: DataFrame, keys: list[str], degree: str) -> DataFrame:
    """Give every token the values of its (prev, token) pair.

    Each distinct pair is scored once, in a written table; ``degree`` there counts the
    tokens that are this pair.
    """
    started = near.withColumn("prev", F.coalesce("prev", F.lit(START)))
    return lookup(started, scored, ["prev", "token"], [*keys, "pos"], degree)


def lm_loss(
    scores: DataFrame, by: list[str], logp: str = "logp", count: Column | None = None
) -> DataFrame:
    """Mean negative log-likelihood and perplexity; ``count`` weighs pre-counted rows."""
    times = F.lit(1) if count is None else count
    return (
        scores.groupBy(*by)
        .agg(F.sum(times).alias("tokens"), F.sum(-F.col(logp) * times).alias("_nll"))
        .select(
            *by,
            "tokens",
            (F.col("_nll") / F.col("tokens")).alias("loss"),
            F.exp(F.col("_nll") / F.col("tokens")).alias("perplexity"),
        )
    )


def joint_distribution(base: DataFrame, model: DataFrame, on: list[str]) -> DataFrame:
    """Two tables (on, p) as one (on, p_base, p_model), zero where one lacks a row."""
    zero = F.lit(0.0)
    return (
        base.select(*on, F.col("p").alias("p_base"), zero.alias("p_model"))
        .unionByName(model.select(*on, zero.alias("p_base"), F.col("p").alias("p_model")))
        .groupBy(*on)
        .agg(F.sum("p_base").alias("p_base"), F.sum("p_model").alias("p_model"))
    )


def kl_term(base: Column, model: Column) -> Column:
    """One summand of KL(base, model) in nats."""
    return (
        F.when(base <= 0, 0.0)
        .when(model <= 0, float("inf"))
        .otherwise(base * (F.ln(base) - F.ln(model)))
    )


def kl_to_baseline(
    joint: DataFrame, base: str = "p_base", model: str = "p_model"
) -> DataFrame:
    """KL from the base to the model over the joint vocabulary: types, kl."""
    return joint.agg(
        F.count("*").alias("types"), F.sum(kl_term(F.col(base), F.col(model))).alias("kl")
    )


def anchor_penalty(model: DataFrame, weight: float) -> DataFrame:
    """Mean KL to the base over the anchor (base) tokens, training loss, and their total.

    ``model`` has a row per pair with n_train, n_base, p_base and p_model.
    """
    n = F.col("n_base")
    sums = model.agg(
        F.sum(n).alias("anchor_tokens"),
        (F.sum(n * (F.ln("p_base") - F.ln("p_model"))) / F.sum(n)).alias("kl"),
        (F.sum(-F.col("n_train") * F.ln("p_model")) / F.sum("n_train")).alias("train_loss"),
    )
    total = F.col("train_loss") + float(weight) * F.col("kl")
    return sums.withColumn("total_loss", total)


def total_loss(losses: DataFrame, weights: dict[str, float], run: list[str]) -> DataFrame:
    """Weighted sum of the losses of each run (columns loss_class, value).

    A loss without a weight counts as it is.
    """
    scale = reduce(
        lambda chain, item: chain.when(F.col("loss_class") == item[0], float(item[1])),
        weights.items(),
        F.when(F.lit(False), 0.0),
    ).otherwise(1.0)
    return losses.groupBy(*run).agg(F.sum(scale * F.col("value")).alias("total_loss"))


def weight_sweep(words: DataFrame, weights: list[float]) -> DataFrame:
    """Losses of the adapted unigram for many KL weights in one pass over the words.

    Every weight is a set of aggregates, so no row is copied per weight.
    """
    train, base = F.col("p_train"), F.col("p_base")
    sums = []
    for i, weight in enumerate(weights):
        model = blended(train, base, weight)
        sums += [
            F.sum(-train * F.ln(model)).alias(f"_train_{i}"),
            F.sum(kl_term(base, model)).alias(f"_kl_{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(w)).alias("weight"),
                F.col(f"_train_{i}").alias("train_loss"),
                F.col(f"_kl_{i}").alias("kl"),
                (F.col(f"_train_{i}") + float(w) * F.col(f"_kl_{i}")).alias("total_loss"),
            )
            for i, w in enumerate(weights)
        ]
    )
    return words.agg(*sums).select(F.inline(rows))


def loss_classes(model: DataFrame) -> DataFrame:
    """What any KL weight needs to know of a bigram model: p_train, p_base, n_train, n_base.

    Pairs of the same two chances are one row. Most pairs are rare words after rare words, which share
    their counts, so the classes are far fewer than the pairs; write them to try weights on.
    """
    return model.groupBy("p_train", "p_base").agg(
        F.sum("n_train").alias("n_train"), F.sum("n_base").alias("n_base")
    )


def bigram_sweep(classes: DataFrame, weights: list[float]) -> DataFrame:
    """Training loss, KL to the base on the anchors and their total for many weights.

    For each weight what ``anchor_penalty`` says of the bigram adapted with it, from one pass over
    the written classes: every weight is two sums of that pass, and no row is copied.
    """
    train, base = F.col("n_train"), F.col("n_base")
    sums = [F.sum(train).alias("_train"), F.sum(base).alias("_base")]
    for i, weight in enumerate(weights):
        model = F.ln(blended(F.col("p_train"), F.col("p_base"), weight))
        sums += [
            F.sum(-train * model).alias(f"_loss_{i}"),
            F.sum(base * (F.ln("p_base") - model)).alias(f"_kl_{i}"),
        ]
    rows = []
    for i, weight in enumerate(weights):
        loss, kl = F.col(f"_loss_{i}") / F.col("_train"), F.col(f"_kl_{i}") / F.col("_base")
        rows.append(
            F.struct(
                F.lit(float(weight)).alias("weight"),
                loss.alias("train_loss"),
                kl.alias("kl"),
                (loss + float(weight) * kl).alias("total_loss"),
            )
        )
    return classes.agg(*sums).select(F.inline(F.array(*rows)))


def top_words(
    words: DataFrame, k: int, base: str = "p_base", model: str = "p_model"
) -> DataFrame:
    """The k words whose probability moved most, ties by word."""
    moved = words.withColumn("delta", F.col(model) - F.col(base))
    return moved.orderBy(F.abs("delta").desc(), "token").limit(k)


def _hidden(side: str) -> Column:
    return F.col(side).isNull() | (F.col(side) == MASK)


def cloze_scores(
    slots: DataFrame,
    candidates: list[str],
    pairs: DataFrame,
    words: DataFrame,
    contexts: DataFrame,
    part: str,
    mu: float = MU,
) -> DataFrame:
    """Add ``scores``, one per candidate in the order of the alphabet, and their ``total``.

    The score is p(w | left) p(right | w), to be divided by the total; a neighbour that is
    hidden or absent tells nothing. For every candidate's score; the chance of the hidden
    word alone needs no array (``cloze.cloze_chances``). Each left word and each right word gets one array
    over the candidates, and slots multiply two arrays: no row per slot and candidate
    is joined. ``words`` must hold the candidates and the words around the slots.
    """
    listed = sorted(set(candidates))
    n, p, context = f"n_{part}", f"p_{part}", f"context_{part}"

    place = F.create_map(*[F.lit(x) for i, w in enumerate(listed) for x in (w, i)])
    places = F.lit(list(range(len(listed))))

    def by_place(of: str, value: str) -> Column:
        """Map from a candidate's place to its value: at most one entry per candidate."""
        return F.map_from_entries(F.collect_list(F.struct(place[F.col(of)], F.col(value))))

    def dense(sparse: Column) -> Column:
        return F.transform(places, lambda i: F.coalesce(sparse[i].cast("double"), F.lit(0.0)))

    own_words = words.filter(is_one_of(F.col("token"), listed))
    own_contexts = contexts.filter(is_one_of(F.col("prev"), listed))
    unigrams = own_words.agg(by_place("token", p).alias("m")).select(dense(F.col("m"))).scalar()
    own_context = (
        own_contexts.agg(by_place("prev", context).alias("m")).select(dense(F.col("m"))).scalar()
    )
    followers = (
        pairs.filter(is_one_of(F.col("token"), listed) & (F.col("prev") != START))
        .groupBy(F.col("prev").alias("_left"))
        .agg(by_place("token", n).alias("_n"))
    )
    leaders = (
        pairs.filter(is_one_of(F.col("prev"), listed))
        .groupBy(F.col("token").alias("_right"))
        .agg(by_place("prev", n).alias("_n"))
    )
    lefts = (
        slots.filter(~_hidden("left"))
        .groupBy(F.col("left").alias("_left"))
        .agg(F.count("*").alias("_degree"))
        .join(contexts.select(F.col("prev").alias("_left"), context), "_left", "left")
        .join(followers, "_left", "left")
        .withColumn("_own", unigrams)
        .select(
            "_left",
            "_degree",
            F.zip_with(
                dense(F.col("_n")),
                "_own",
                lambda c, u: (c + mu * u) / (F.coalesce(F.col(context), F.lit(0)) + mu),
            ).alias("_from_left"),
        )
    )
    rights = (
        slots.filter(~_hidden("right"))
        .groupBy(F.col("right").alias("_right"))
        .agg(F.count("*").alias("_degree"))
        .join(words.select(F.col("token").alias("_right"), p), "_right")
        .join(leaders, "_right", "left")
        .withColumn("_own", own_context)
        .select(
            "_right",
            "_degree",
            F.zip_with(
                dense(F.col("_n")), "_own", lambda c, of: (c + mu * F.col(p)) / (of + mu)
            ).alias("_to_right"),
        )
    )
    sided = slots.withColumn("_left", F.when(~_hidden("left"), F.col("left"))).withColumn(
        "_right", F.when(~_hidden("right"), F.col("right"))
    )
    salt = slots.columns
    near = lookup(sided, written(lefts, "lefts"), ["_left"], salt, "_degree")
    both = lookup(near, written(rights, "rights"), ["_right"], salt, "_degree")
    raw = F.when(F.col("_to_right").isNull(), F.col("_from_left")).otherwise(
        F.zip_with("_from_left", "_to_right", lambda a, b: a * b)
    )
    known = both.withColumn("_from_left", F.coalesce("_from_left", unigrams))
    # Dividing here would put the sum into the lambda and add up anew for every score.
    return known.select(*slots.columns, raw.alias("scores")).withColumn(
        "total", F.aggregate("scores", F.lit(0.0), lambda total, x: total + x)
    )


def cloze_candidates(scored: DataFrame, candidates: list[str]) -> DataFrame:
    """One row per slot and candidate; the scores of a slot sum to one."""
    kept = [c for c in scored.columns if c not in ("scores", "total")]
    named = F.arrays_zip(
        F.lit(sorted(set(candidates))).alias("candidate"), F.col("scores").alias("score")
    )
    return scored.select(*kept, "total", F.inline(named)).select(
        *kept, "candidate", (F.col("score") / F.col("total")).alias("score")
    )
