"""Probabilities, losses and the closed-form adaptation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from verbena.operators import joins
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
    loss_classes,
    merged_counts,
    pair_counts,
    score_tokens,
    token_counts,
    total_loss,
    weight_sweep,
    with_words,
    words_of_pairs,
)
from verbena.operators.masking import mask_targets
from verbena.operators.tokens import neighbours, tokenize
from verbena.plans.models import document_words

PARTS = ["train", "base"]
TEXTS = [
    (1, "train", "the cat sat on the mat"),
    (2, "train", "the dog"),
    (3, "base", "a dog sat on a cat and the cat ran"),
    (4, "base", ""),
]


@pytest.fixture(scope="module")
def near(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, part string, text string")
    return neighbours(texts, ["doc_id", "part"])


@pytest.fixture(scope="module")
def model(near):
    pairs = pair_counts(near, "part", PARTS).cache()
    words = fit_unigram(words_of_pairs(pairs, PARTS), PARTS).cache()
    return pairs, words, contexts_of_pairs(pairs, PARTS).cache()


def brute(part):
    """Counts and probabilities of one part by plain Python."""
    vocabulary = {w for _, _, t in TEXTS for w in t.split()}
    own = [t.split() for _, p, t in TEXTS if p == part]
    n = {w: sum(t.count(w) for t in own) for w in vocabulary}
    total = sum(n.values())
    p = {w: (n[w] + 1) / (total + len(vocabulary)) for w in vocabulary}
    follow = [(a, b) for t in own for a, b in zip(t, t[1:])]

    def after(prev, w):
        if prev in ("", None):
            return p[w]
        context = sum(a == prev for a, _ in follow)
        return (follow.count((prev, w)) + 10 * p[w]) / (context + 10)

    return vocabulary, p, after


def test_unigram_is_add_one_and_sums_to_one(model):
    words = {r.token: r for r in model[1].collect()}
    for part in PARTS:
        _, p, _ = brute(part)
        assert {w: r[f"p_{part}"] for w, r in words.items()} == pytest.approx(p)
        assert sum(r[f"p_{part}"] for r in words.values()) == pytest.approx(1)


@pytest.fixture(params=["broadcast", "hot keys"])
def join_path(request, monkeypatch):
    """Each lookup once as for a small table and once as for a large one."""
    if request.param == "hot keys":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_KEYS", 2)


def test_bigram_equals_plain_python(model, join_path):
    for r in fit_bigram(*model, PARTS).collect():
        for part in PARTS:
            assert r[f"p_{part}"] == pytest.approx(brute(part)[2](r.prev, r.token))


@pytest.mark.parametrize("part", PARTS)
def test_chances_after_a_word_sum_to_one(part):
    vocabulary, _, after = brute(part)
    for prev in vocabulary:
        assert sum(after(prev, w) for w in vocabulary) == pytest.approx(1)


def test_scored_tokens(model, near, join_path):
    scored = fit_bigram(*model, PARTS).select(
        "prev", "token", (F.col("n_train") + F.col("n_base")).alias("n"), F.ln("p_base").alias("logp")
    )
    rows = score_tokens(near.drop("next"), scored, ["doc_id", "part"], "n").collect()
    assert len(rows) == 18
    after = brute("base")[2]
    for r in rows:
        assert r.logp == pytest.approx(math.log(after(r.prev, r.token)))


def test_kl_by_hand(spark):
    joint = spark.createDataFrame(
        [("a", 0.5, 0.25), ("b", 0.5, 0.75)], "token string, p_base double, p_model double"
    )
    assert kl_to_baseline(joint).first().kl == pytest.approx(0.143841, abs=1e-6)
    assert kl_to_baseline(joint, "p_base", "p_base").first().kl == 0


def test_kl_is_infinite_where_the_model_gives_nothing(spark):
    schema = "token string, p double"
    base = spark.createDataFrame([("a", 0.5), ("b", 0.5)], schema)
    other = spark.createDataFrame([("a", 0.5), ("c", 0.5)], schema)
    assert kl_to_baseline(joint_distribution(base, other, ["token"])).first().kl == math.inf


def test_adaptation_by_hand(spark):
    rows = [("a", 1.0, 0.5), ("b", 0.0, 0.5)]
    df = spark.createDataFrame(rows, "token string, p_train double, p_base double")
    got = {r.token: r.p_model for r in adapt_lm(df, 1.0).collect()}
    assert got == {"a": 0.75, "b": 0.25}


def test_a_large_weight_gives_the_baseline(model):
    near_base = adapt_lm(model[1], 1e9)
    assert near_base.agg(F.max(F.abs(F.col("p_model") - F.col("p_base"))).alias("d")).first().d < 1e-8


def test_adaptation_is_the_minimum(model):
    rows = adapt_lm(model[1], 1.5).select("p_train", "p_base", "p_model").collect()

    def objective(p):
        train = -sum(r.p_train * math.log(q) for r, q in zip(rows, p))
        return train + 1.5 * sum(r.p_base * math.log(r.p_base / q) for r, q in zip(rows, p))

    best = [r.p_model for r in rows]
    assert sum(best) == pytest.approx(1)
    rng = random.Random(1)
    for _ in range(300):
        moved = [q * math.exp(rng.gauss(0, 0.05)) for q in best]
        scale = sum(moved)
        assert objective([q / scale for q in moved]) >= objective(best)


def test_sweep_equals_single_runs(model):
    for r in weight_sweep(model[1], [0.5, 8.0]).collect():
        alone = kl_to_baseline(adapt_lm(model[1], r.weight)).first().kl
        assert r.kl == pytest.approx(alone) and r.kl >= 0
        assert r.total_loss == pytest.approx(r.train_loss + r.weight * r.kl)


def test_bigram_sweep_equals_single_models(model):
    pairs, words, contexts = model
    bigram = fit_bigram(pairs, words, contexts, PARTS)
    classes = loss_classes(bigram)
    assert classes.count() < bigram.count()
    weights = [0.0, 0.5, 1.5, 8.0]
    rows = {r.weight: r for r in bigram_sweep(classes, weights).collect()}
    assert sorted(rows) == weights
    for weight, r in rows.items():
        alone = anchor_penalty(adapt_lm(bigram, weight), weight).first()
        for name in ("train_loss", "kl", "total_loss"):
            assert r[name] == pytest.approx(alone[name])


def test_known_kl_of_the_documents(spark):
    """The adapted model of the first source on the middle tables."""
    model = adapt_lm(document_words(spark, "/root/testdata/sf0.01"), 1.5)
    row = kl_to_baseline(model).first()
    assert row.types == 53_962
    assert row.kl == pytest.approx(0.082392, abs=1e-6)


def test_total_loss(spark):
    rows = [("r", "default", 2.0), ("r", "kl", 0.5), ("r", "other", 100.0)]
    losses = spark.createDataFrame(rows, "run string, loss_class string, value double")
    assert total_loss(losses, {"default": 1, "kl": 8}, ["run"]).first().total_loss == 106.0


def test_counts_add_up(near):
    tokens = near.select("doc_id", "part", "token")
    whole = token_counts(tokens, "part", PARTS)
    halves = [token_counts(tokens.filter(f"doc_id % 2 = {i}"), "part", PARTS) for i in (0, 1)]
    assert whole.exceptAll(merged_counts(halves, ["token"], PARTS)).count() == 0


def test_cloze_equals_plain_python(spark, model, join_path):
    texts = spark.createDataFrame(TEXTS, "doc_id long, part string, text string")
    listed = ["cat", "dog", "the", "unheard"]
    pairs, _, contexts = model
    words = fit_unigram(with_words(words_of_pairs(pairs, PARTS), listed, PARTS), PARTS)
    slots = mask_targets(texts, ["doc_id"], listed)
    scored = cloze_scores(slots, listed, pairs, words, contexts, "base")
    got = {
        (r.doc_id, r.pos, r.candidate): r.score for r in cloze_candidates(scored, listed).collect()
    }
    p = {r.token: r.p_base for r in words.collect()}
    n = {(r.prev, r.token): r.n_base for r in pairs.collect()}
    c = {r.prev: r.context_base for r in contexts.collect()}

    def after(prev, w):
        return (n.get((prev, w), 0) + 10 * p[w]) / (c.get(prev, 0) + 10)

    rows = slots.collect()
    assert len(got) == len(rows) * 4
    for r in rows:
        raw = {}
        for w in listed:
            left = p[w] if r.left in (None, "[MASK]") else after(r.left, w)
            right = 1 if r.right in (None, "[MASK]") else after(w, r.right)
            raw[w] = left * right
        for w in listed:
            assert got[r.doc_id, r.pos, w] == pytest.approx(raw[w] / sum(raw.values()))
