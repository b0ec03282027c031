"""Count-based models: fitted, adapted, scored and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.operators.cloze import cloze_chances, masked_loss
from verbena.operators.grid import condition_cube, pair_with_baseline
from verbena.operators.joins import lookup
from verbena.operators.language import (
    adapt_lm,
    anchor_penalty,
    bigram_sweep,
    cloze_candidates,
    cloze_scores,
    contexts_of_pairs,
    fit_bigram,
    fit_unigram,
    joint_distribution,
    kl_to_baseline,
    lm_loss,
    loss_classes,
    pair_counts,
    score_tokens,
    token_counts,
    top_words,
    total_loss,
    weight_sweep,
    with_words,
    words_of_pairs,
)
from verbena.operators.lexicons import distinct_words
from verbena.operators.masking import mask_targets
from verbena.operators.tokens import neighbours, tokenize
from verbena.plans.registry import query
from verbena.plans.tables import (
    BENCH,
    CONV,
    PARTS,
    STAND_INS,
    TOK,
    conversations,
    documents,
    parted,
    read,
    words_in,
)
from verbena.session import written

WEIGHT = 1.5
WEIGHTS = [0.5, 1.0, 1.5, 8.0, 257.0]
TESTS = ["benchmark", "conversations"]


def sql_models(parts: list[str], source: str) -> str:
    """SQL twin of the count tables and the smoothed models over ``source`` (near rows)."""
    counts = ", ".join(f"count(*) FILTER (part = '{p}') AS n_{p}" for p in parts)
    sums = ", ".join(f"sum(n_{p}) AS t_{p}" for p in parts)
    uni = ", ".join(f"n_{p}, (n_{p} + 1) / (t_{p} + v)::DOUBLE AS p_{p}" for p in parts)
    ctx = ", ".join(f"count(*) FILTER (part = '{p}') AS c_{p}" for p in parts)
    big = ", ".join(
        f"pairs.n_{p}, ((CASE WHEN pairs.prev <> '' THEN pairs.n_{p} ELSE 0 END) + 10.0 * uni.p_{p})"
        f" / (coalesce(c_{p}, 0) + 10.0) AS p_{p}"
        for p in parts
    )
    return f"""{source},
    words AS (SELECT token, {counts} FROM near GROUP BY token),
    tot AS (SELECT count(*) AS v, {sums} FROM words),
    uni AS (SELECT token, {uni} FROM words CROSS JOIN tot),
    pairs AS (SELECT prev, token, {counts} FROM near GROUP BY prev, token),
    ctx AS (SELECT prev, {ctx} FROM near WHERE prev <> '' GROUP BY prev),
    big AS (SELECT pairs.prev, pairs.token, {big}
            FROM pairs JOIN uni ON uni.token = pairs.token
            LEFT JOIN ctx ON ctx.prev = pairs.prev)"""


DOC_NEAR = f"""{TOK}, near AS (
  SELECT CASE source WHEN 'src1' THEN 'train' ELSE 'base' END AS part, source, doc_id, pos, token,
         coalesce(lag(token) OVER w, '') AS prev, lead(token) OVER w AS next
  FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
TEST_NEAR = f"""{TOK}, {CONV}, {BENCH}, conv_near AS (
  SELECT conv_id, turn, pos, token,
         coalesce(lag(token) OVER (PARTITION BY conv_id, turn ORDER BY pos), '') AS prev
  FROM conv), near AS (
  SELECT CASE source WHEN 'src1' THEN 'train' ELSE 'base' END AS part, token,
         coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY pos), '') AS prev FROM tok
  UNION ALL SELECT 'conversations', token, prev FROM conv_near
  UNION ALL SELECT 'benchmark', token,
         coalesce(lag(token) OVER (PARTITION BY item_id ORDER BY pos), '') FROM bench)"""
DOC_SQL = sql_models(PARTS, DOC_NEAR)
TEST_SQL = sql_models(PARTS + TESTS, TEST_NEAR)


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigrams of train and base over the words of all documents."""
    tokens = tokenize(parted(spark, sf_dir), ["role"])
    counts = token_counts(tokens, "role", PARTS)
    return fit_unigram(counts, PARTS)


def models_of_pairs(
    pairs: DataFrame, parts: list[str], extra: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Words and contexts, both out of one written pair table."""
    words = words_of_pairs(pairs, parts)
    if extra:
        words = with_words(words, extra, parts)
    contexts = contexts_of_pairs(pairs, parts)
    return written(fit_unigram(words, parts), "words"), written(contexts, "contexts")


def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts of train, base and the two test tables over one vocabulary."""
    texts = parted(spark, sf_dir).select("role", "text")
    for name, df in (
        ("benchmark", read(spark, sf_dir, "benchmark")),
        ("conversations", conversations(spark, sf_dir)),
    ):
        texts = texts.unionByName(df.select(F.lit(name).alias("role"), "text"))
    return written(pair_counts(neighbours(texts, ["role"]), "role", PARTS + TESTS), "pairs")


def scored_test_pairs(spark: SparkSession, sf_dir: str, tests: list[str]) -> DataFrame:
    """Train, base and adapted probabilities of the pairs that occur in the tests."""
    pairs = test_pairs(spark, sf_dir)
    words, contexts = models_of_pairs(pairs, PARTS + TESTS)
    occurring = sum((F.col(f"n_{t}") for t in tests[1:]), F.col(f"n_{tests[0]}")) > 0
    scored = fit_bigram(pairs.filter(occurring), words, contexts, PARTS)
    return adapt_lm(scored, WEIGHT)


@query(
    "fit_unigram",
    f"""WITH {DOC_SQL} SELECT token, n_train, n_base, round(p_train, 12) AS p_train,
           round(p_base, 12) AS p_base FROM uni""",
)
def unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_words(spark, sf_dir).select(
        "token",
        "n_train",
        "n_base",
        F.round("p_train", 12).alias("p_train"),
        F.round("p_base", 12).alias("p_base"),
    )


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(parted(spark, sf_dir), ["role"])
    return written(pair_counts(near, "role", PARTS), "pairs")


def document_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = document_pairs(spark, sf_dir)
    words, contexts = models_of_pairs(pairs, PARTS)
    return fit_bigram(pairs, words, contexts, PARTS)


@query(
    "fit_bigram",
    f"""WITH {DOC_SQL} SELECT prev, token, n_train, n_base, round(p_train, 10) AS p_train,
           round(p_base, 10) AS p_base FROM big""",
)
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_bigrams(spark, sf_dir).select(
        "prev",
        "token",
        "n_train",
        "n_base",
        F.round("p_train", 10).alias("p_train"),
        F.round("p_base", 10).alias("p_base"),
    )


@query(
    "adapt_unigram",
    f"""WITH {DOC_SQL} SELECT token, round((p_train + 1.5 * p_base) / 2.5, 12) AS p_model
    FROM uni""",
)
def adapted_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = adapt_lm(document_words(spark, sf_dir), WEIGHT)
    return model.select("token", F.round("p_model", 12).alias("p_model"))


@query(
    "adapt_bigram",
    f"""WITH {DOC_SQL} SELECT prev, token, round((p_train + 1.5 * p_base) / 2.5, 10) AS p_model
    FROM big""",
)
def adapted_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = adapt_lm(document_bigrams(spark, sf_dir), WEIGHT)
    return model.select("prev", "token", F.round("p_model", 10).alias("p_model"))


def scored_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the conversations with its log-probability under the base model."""
    scored = written(
        scored_test_pairs(spark, sf_dir, ["conversations"]).select(
            "prev", "token", F.col("n_conversations").alias("n"), F.ln("p_base").alias("logp")
        ),
        "scored",
    )
    near = neighbours(conversations(spark, sf_dir), ["conv_id", "turn"]).drop("next")
    return score_tokens(near, scored, ["conv_id", "turn"], "n")


SCORED_CONV = f"""{TEST_SQL}, scored AS (
  SELECT c.conv_id, c.turn, c.pos, c.prev, c.token, ln(b.p_base) AS logp
  FROM conv_near c JOIN big b ON b.prev = c.prev AND b.token = c.token)"""


@query(
    "score_tokens",
    f"""WITH {SCORED_CONV} SELECT conv_id, turn, pos, prev, token, round(logp, 6) AS logp
    FROM scored""",
)
def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_conversations(spark, sf_dir).withColumn("logp", F.round("logp", 6))


@query(
    "lm_loss",
    f"""WITH {SCORED_CONV} SELECT conv_id, turn, count(*) AS tokens,
           round(avg(-logp), 6) AS loss, round(exp(avg(-logp)), 3) AS perplexity
    FROM scored GROUP BY conv_id, turn""",
)
def losses_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = lm_loss(scored_conversations(spark, sf_dir), ["conv_id", "turn"])
    return losses.withColumn("loss", F.round("loss", 6)).withColumn(
        "perplexity", F.round("perplexity", 3)
    )


def test_losses(scored: DataFrame, column: str, name: str) -> DataFrame:
    """dataset, tokens and the mean loss of each test table, from its distinct pairs."""
    rows = F.array(
        *[F.struct(F.lit(t).alias("dataset"), F.col(f"n_{t}").alias("n")) for t in TESTS]
    )
    long = scored.select(F.ln(column).alias("logp"), F.inline(rows)).filter("n > 0")
    return lm_loss(long, ["dataset"], count=F.col("n")).select(
        "dataset", "tokens", F.col("loss").alias(name)
    )


KL_SQL = "sum(p_base * (ln(p_base) - ln((p_train + 1.5 * p_base) / 2.5)))"


@query(
    "adapt_and_score",
    f"""WITH {TEST_SQL},
    seen AS (SELECT prev, token, p_base, (p_train + 1.5 * p_base) / 2.5 AS p_model,
                    unnest(['benchmark', 'conversations']) AS dataset,
                    unnest([n_benchmark, n_conversations]) AS n FROM big),
    train AS (SELECT sum(-p_train * ln((p_train + 1.5 * p_base) / 2.5)) AS loss, {KL_SQL} AS kl
              FROM uni)
    SELECT dataset, sum(n)::BIGINT AS tokens, round(sum(-n * ln(p_base)) / sum(n), 6) AS base_loss,
           round(sum(-n * ln(p_model)) / sum(n), 6) AS model_loss,
           round(any_value(kl), 6) AS unigram_kl,
           round(any_value(loss + 1.5 * kl), 6) AS unigram_total_loss
    FROM seen CROSS JOIN train WHERE n > 0 GROUP BY dataset""",
)
def adapt_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair table gives the models, their KL, the training loss and the test losses.

    Test losses are those of the bigram; the penalty of the bigram itself is ``anchor_kl``.
    """
    pairs = test_pairs(spark, sf_dir)
    words, contexts = models_of_pairs(pairs, PARTS + TESTS)
    tested = pairs.filter(" + ".join(f"n_{t}" for t in TESTS) + " > 0")
    scored = adapt_lm(fit_bigram(tested, words, contexts, PARTS), WEIGHT)
    both = F.array(
        *[F.struct(F.lit(t).alias("dataset"), F.col(f"n_{t}").alias("n")) for t in TESTS]
    )
    n = F.col("n")
    losses = (
        scored.select("p_base", "p_model", F.inline(both))
        .filter("n > 0")
        .groupBy("dataset")
        .agg(
            F.sum(n).alias("tokens"),
            F.sum(-F.ln("p_base") * n).alias("_base"),
            F.sum(-F.ln("p_model") * n).alias("_model"),
        )
    )
    sweep = weight_sweep(words, [WEIGHT]).select(F.struct("kl", "total_loss")).scalar()
    return losses.select(
        "dataset",
        "tokens",
        F.round(F.col("_base") / F.col("tokens"), 6).alias("base_loss"),
        F.round(F.col("_model") / F.col("tokens"), 6).alias("model_loss"),
        F.round(sweep.getField("kl"), 6).alias("unigram_kl"),
        F.round(sweep.getField("total_loss"), 6).alias("unigram_total_loss"),
    )


@query(
    "anchor_kl",
    f"""WITH {DOC_SQL}, adapted AS (
      SELECT n_train, n_base, p_base, (p_train + 1.5 * p_base) / 2.5 AS p_model FROM big),
    sums AS (SELECT sum(n_base)::BIGINT AS anchor_tokens,
                    sum(n_base * (ln(p_base) - ln(p_model))) / sum(n_base) AS kl,
                    sum(-n_train * ln(p_model)) / sum(n_train) AS train_loss
             FROM adapted)
    SELECT anchor_tokens, round(kl, 6) AS kl, round(train_loss, 6) AS train_loss,
           round(train_loss + 1.5 * kl, 6) AS total_loss FROM sums""",
)
def bigram_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KL penalty and the total loss of the adapted bigram, the model that is tested.

    The anchors are the base texts, every token of them: the mean of ln p_base - ln p_model over
    the pairs that occur, by their counts, so no distribution over all words is built.
    """
    model = adapt_lm(document_bigrams(spark, sf_dir), WEIGHT)
    sums = anchor_penalty(model, WEIGHT)
    rounded = [F.round(c, 6).alias(c) for c in ("kl", "train_loss", "total_loss")]
    return sums.select("anchor_tokens", *rounded)


@query(
    "lm_loss_by_dataset",
    f"""WITH {TEST_SQL},
    seen AS (SELECT p_base, unnest(['benchmark', 'conversations']) AS dataset,
                    unnest([n_benchmark, n_conversations]) AS n FROM big)
    SELECT dataset, sum(n)::BIGINT AS tokens, round(sum(-n * ln(p_base)) / sum(n), 6) AS loss
    FROM seen WHERE n > 0 GROUP BY dataset""",
)
def losses_of_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = test_losses(scored_test_pairs(spark, sf_dir, TESTS), "p_base", "loss")
    return losses.withColumn("loss", F.round("loss", 6))


@query(
    "kl_to_baseline",
    f"""WITH {DOC_SQL} SELECT count(*) AS types, round({KL_SQL}, 6) AS kl FROM uni""",
)
def kl_of_adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = adapt_lm(document_words(spark, sf_dir), WEIGHT)
    return kl_to_baseline(model).withColumn("kl", F.round("kl", 6))


@query(
    "kl_of_tables",
    f"""WITH {TOK}, {CONV}, a AS (SELECT token, count(*) AS n FROM conv GROUP BY token),
    b AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
    pa AS (SELECT token, n / (SELECT sum(n) FROM a) AS p FROM a),
    pb AS (SELECT token, n / (SELECT sum(n) FROM b) AS p FROM b),
    j AS (SELECT coalesce(pa.p, 0) AS q, coalesce(pb.p, 0) AS p
          FROM pa FULL JOIN pb ON pa.token = pb.token),
    m AS (SELECT q, (p + q) / 2 AS h FROM j)
    SELECT count(*) AS types, round(sum(CASE WHEN q > 0 THEN q * (ln(q) - ln(h)) ELSE 0 END), 6) AS kl
    FROM m""",
)
def kl_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KL of the conversations from an even mixture of conversations and documents."""

    def shares(texts: DataFrame) -> DataFrame:
        counts = tokenize(texts, []).groupBy("token").agg(F.count("*").alias("n"))
        whole = counts.agg(F.sum("n").alias("n")).scalar()
        return counts.select("token", (F.col("n") / whole).alias("p"))

    joint = joint_distribution(
        shares(conversations(spark, sf_dir)), shares(documents(spark, sf_dir)), ["token"]
    ).withColumn("p_model", (F.col("p_base") + F.col("p_model")) / 2)
    return kl_to_baseline(joint).withColumn("kl", F.round("kl", 6))


@query(
    "total_loss",
    f"""WITH {DOC_SQL} SELECT weight AS run,
           round(sum(-p_train * ln((p_train + weight * p_base) / (1 + weight)))
                 + 1.5 * sum(p_base * (ln(p_base) - ln((p_train + weight * p_base) / (1 + weight))))
                 + 0.25, 6) AS total_loss
    FROM uni CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (1.5), (8.0), (257.0)) AS w(weight)
    GROUP BY weight""",
)
def losses_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of several KL weights, all judged by the same weighted sum of losses."""
    sweep = weight_sweep(document_words(spark, sf_dir), WEIGHTS)
    rows = F.array(
        F.struct(F.lit("default").alias("loss_class"), F.col("train_loss").alias("value")),
        F.struct(F.lit("kl_baseline").alias("loss_class"), F.col("kl").alias("value")),
        F.struct(F.lit("unweighted").alias("loss_class"), F.lit(0.25).alias("value")),
    )
    long = sweep.select(F.col("weight").alias("run"), F.inline(rows))
    totals = total_loss(long, {"default": 1.0, "kl_baseline": WEIGHT}, ["run"])
    return totals.withColumn("total_loss", F.round("total_loss", 6))


@query(
    "weight_sweep",
    f"""WITH {DOC_SQL}, swept AS (
      SELECT weight, sum(-p_train * ln((p_train + weight * p_base) / (1 + weight))) AS train_loss,
             sum(p_base * (ln(p_base) - ln((p_train + weight * p_base) / (1 + weight)))) AS kl
      FROM uni CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (1.5), (8.0), (257.0)) AS w(weight)
      GROUP BY weight)
    SELECT weight, round(train_loss, 6) AS train_loss, round(kl, 6) AS kl,
           round(train_loss + weight * kl, 6) AS total_loss FROM swept""",
)
def weights_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = weight_sweep(document_words(spark, sf_dir), WEIGHTS)
    return sweep.select(
        "weight", *[F.round(c, 6).alias(c) for c in ("train_loss", "kl", "total_loss")]
    )


@query(
    "bigram_weight_sweep",
    f"""WITH {DOC_SQL}, swept AS (
      SELECT weight, sum(-n_train * ln((p_train + weight * p_base) / (1 + weight))) / sum(n_train)
               AS train_loss,
             sum(n_base * (ln(p_base) - ln((p_train + weight * p_base) / (1 + weight)))) / sum(n_base)
               AS kl
      FROM big CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (1.5), (8.0), (257.0)) AS w(weight)
      GROUP BY weight)
    SELECT weight, round(train_loss, 6) AS train_loss, round(kl, 6) AS kl,
           round(train_loss + weight * kl, 6) AS total_loss FROM swept""",
)
def bigram_weights_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of ``weight_sweep`` for the model that is tested, the bigram."""
    classes = written(loss_classes(document_bigrams(spark, sf_dir)), "classes")
    sweep = bigram_sweep(classes, WEIGHTS)
    return sweep.select(
        "weight", *[F.round(c, 6).alias(c) for c in ("train_loss", "kl", "total_loss")]
    )


@query(
    "top_words",
    f"""WITH {DOC_SQL} SELECT token, round(p_base, 10) AS p_base,
           round((p_train + 1.5 * p_base) / 2.5, 10) AS p_model,
           round((p_train + 1.5 * p_base) / 2.5 - p_base, 10) AS delta
    FROM uni ORDER BY abs((p_train + 1.5 * p_base) / 2.5 - p_base) DESC, token LIMIT 50""",
)
def words_that_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = top_words(adapt_lm(document_words(spark, sf_dir), WEIGHT), 50)
    return moved.select(
        "token", *[F.round(c, 10).alias(c) for c in ("p_base", "p_model", "delta")]
    )


def sql_cloze(words: str) -> str:
    """SQL twin of the cloze scores of the listed words over the documents."""
    return f"""{DOC_SQL},
    slots AS (
      SELECT source, token AS target, count(*) AS n,
             CASE WHEN prev IN ({words}) THEN '[MASK]' ELSE nullif(prev, '') END AS l,
             CASE WHEN next IN ({words}) THEN '[MASK]' ELSE next END AS r
      FROM near WHERE token IN ({words}) GROUP BY ALL),
    asked AS (SELECT DISTINCT l, r FROM slots),
    cand AS (SELECT token AS w, p_base AS p FROM uni WHERE token IN ({words})),
    raw AS (
      SELECT a.l, a.r, cand.w,
             CASE WHEN a.l IS NULL OR a.l = '[MASK]' THEN cand.p
                  ELSE (coalesce(f.n_base, 0) + 10.0 * cand.p) / (coalesce(cl.c_base, 0) + 10.0) END
             * CASE WHEN a.r IS NULL OR a.r = '[MASK]' THEN 1.0
                    ELSE (coalesce(t.n_base, 0) + 10.0 * ur.p_base)
                         / (coalesce(cw.c_base, 0) + 10.0) END AS x
      FROM asked a CROSS JOIN cand
      LEFT JOIN pairs f ON f.prev = a.l AND f.token = cand.w
      LEFT JOIN ctx cl ON cl.prev = a.l
      LEFT JOIN pairs t ON t.prev = cand.w AND t.token = a.r
      LEFT JOIN ctx cw ON cw.prev = cand.w
      LEFT JOIN uni ur ON ur.token = a.r),
    cloze AS (SELECT l, r, w, x / sum(x) OVER (PARTITION BY l, r) AS score FROM raw)"""


def slots_of_documents(
    spark: SparkSession, sf_dir: str, words: list[str], keys: list[str]
) -> DataFrame:
    """The distinct slots of some words and how often each stands in the documents."""
    docs = documents(spark, sf_dir, "source", "text")
    return (
        mask_targets(docs, ["source"], words)
        .groupBy(*keys, "target", "left", "right")
        .agg(F.count("*").alias("n"))
    )


@query(
    "cloze_candidates",
    f"""WITH {sql_cloze(words_in('own_c'))},
    summed AS (SELECT target, l, r, sum(n)::BIGINT AS n FROM slots GROUP BY ALL)
    SELECT target, s.l AS "left", s.r AS "right", n, w AS candidate, round(score, 8) AS score
    FROM summed s JOIN cloze c ON c.l IS NOT DISTINCT FROM s.l AND c.r IS NOT DISTINCT FROM s.r""",
)
def cloze_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = STAND_INS["own_c"]
    pairs = document_pairs(spark, sf_dir)
    unigram, contexts = models_of_pairs(pairs, PARTS, extra=words)
    slots = written(slots_of_documents(spark, sf_dir, words, []), "slots")
    scored = cloze_scores(slots, words, pairs, unigram, contexts, "base")
    return cloze_candidates(scored, words).withColumn("score", F.round("score", 8))


@query(
    "masked_loss",
    f"""WITH {sql_cloze(words_in(*STAND_INS))}
    SELECT source, sum(n)::BIGINT AS slots, round(sum(-n * ln(score)) / sum(n), 6) AS loss,
           round(exp(sum(-n * ln(score)) / sum(n)), 4) AS perplexity
    FROM slots s JOIN cloze c ON c.w = s.target AND c.l IS NOT DISTINCT FROM s.l
      AND c.r IS NOT DISTINCT FROM s.r
    GROUP BY source""",
)
def losses_of_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's hidden words among all listed ones, by sums instead of candidates."""
    words = distinct_words(STAND_INS)
    pairs = document_pairs(spark, sf_dir)
    unigram, contexts = models_of_pairs(pairs, PARTS, extra=words)
    slots = slots_of_documents(spark, sf_dir, words, ["source"])
    chances = cloze_chances(slots, pairs, unigram, contexts, ["base"], words)
    losses = masked_loss(chances, ["source"], "q_base")
    return losses.withColumn("loss", F.round("loss", 6)).withColumn(
        "perplexity", F.round("perplexity", 4)
    )


@query(
    "losses_against_baseline",
    f"""WITH {TEST_SQL}, scored AS (
      SELECT c.conv_id, c.turn, -ln((b.p_train + 1.5 * b.p_base) / 2.5) AS model_nll,
             -ln(b.p_base) AS base_nll
      FROM conv_near c JOIN big b ON b.prev = c.prev AND b.token = c.token)
    SELECT conv_id, turn, round(avg(model_nll), 6) AS loss, round(avg(base_nll), 6) AS base_loss,
           round(avg(model_nll) - avg(base_nll), 6) AS delta
    FROM scored GROUP BY conv_id, turn""",
)
def losses_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adapting does to each test item: its loss next to that of the base model."""
    item = ["conv_id", "turn"]
    scored = written(
        scored_test_pairs(spark, sf_dir, ["conversations"]).select(
            "prev",
            "token",
            F.col("n_conversations").alias("n"),
            F.ln("p_base").alias("base_logp"),
            F.ln("p_model").alias("model_logp"),
        ),
        "scored",
    )
    near = neighbours(conversations(spark, sf_dir), item).drop("next")
    tokens = score_tokens(near, scored, item, "n")
    # The tokens are scored once: both losses are those of one row an item, of as many tokens.
    means = [(F.sum(c) / F.count("*")).alias(c) for c in ("model_logp", "base_logp")]
    items = written(tokens.groupBy(*item).agg(F.count("*").alias("count"), *means), "items")
    paired = pair_with_baseline(
        lm_loss(items, item, "model_logp", F.col("count")),
        lm_loss(items, item, "base_logp", F.col("count")),
        item,
        "loss",
    )
    return paired.select(*item, *[F.round(c, 6).alias(c) for c in ("loss", "base_loss", "delta")])


@query(
    "loss_by_condition",
    f"""WITH {DOC_SQL},
    losses AS (SELECT doc_id, avg(-ln(p_base)) AS loss
               FROM near JOIN uni ON uni.token = near.token GROUP BY doc_id),
    scores AS (SELECT d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, loss
               FROM losses JOIN documents d ON d.doc_id = losses.doc_id
               LEFT JOIN labels l ON l.doc_id = losses.doc_id)
    SELECT lang, quality, toxic, grouping(lang, quality, toxic) AS level, count(*) AS n,
           round(avg(loss), 6) AS mean
    FROM scores GROUP BY CUBE (lang, quality, toxic)""",
)
def loss_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean document loss over all margins of language and labels."""
    counted = (F.col("n_train") + F.col("n_base")).alias("n")
    words = written(document_words(spark, sf_dir).select("token", "p_base", counted), "words")
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    tokens = lookup(tokenize(docs, ["doc_id", "lang"]), words, ["token"], ["doc_id", "pos"], "n")
    scores = tokens.withColumn("logp", F.ln("p_base"))
    losses = lm_loss(scores, ["doc_id", "lang"])
    labelled = losses.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    margins = condition_cube(
        labelled.na.fill(-1, ["quality", "toxic"]), ["lang", "quality", "toxic"], "loss"
    )
    return margins.withColumn("mean", F.round("mean", 6))
