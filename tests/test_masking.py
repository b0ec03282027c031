"""Tokens, masks and word lists on small frames and known counts."""

import pytest
from pyspark.sql import functions as F

from verbena.operators import joins
from verbena.functions.text import share_threshold, tokens_of
from verbena.operators.lexicons import (
    LEXICONS,
    distinct_words,
    lexicon_overlap,
    lines_with_lexicon,
    lines_without_lexicon,
)
from verbena.operators.masking import (
    mask_if_encoder,
    mask_random_tokens,
    mask_targets,
    mask_word_tokens,
    mask_words_by_lists,
    mask_words_by_table,
    redraw_masks,
)
from verbena.operators.tokens import neighbours, rebuild_text, tokenize
from verbena.plans.tables import STAND_INS, read


@pytest.fixture(scope="module")
def text(spark):
    return spark.createDataFrame(
        [(1, "It is by the Sea."), (2, ""), (3, None), (4, "A b2c")], "doc_id long, text string"
    )


def test_tokens(text):
    rows = tokenize(text, ["doc_id"]).orderBy("doc_id", "pos").collect()
    assert [r.token for r in rows] == ["it", "is", "by", "the", "sea", "a", "b", "c"]
    assert [r.pos for r in rows] == [0, 1, 2, 3, 4, 0, 1, 2]


def test_neighbours(text):
    rows = neighbours(text, ["doc_id"]).filter("doc_id = 4").orderBy("pos").collect()
    assert [(r.prev, r.token, r.next) for r in rows] == [
        (None, "a", "b"),
        ("a", "b", "c"),
        ("b", "c", None),
    ]


def test_known_token_counts(spark, sf_dir):
    tokens = tokenize(read(spark, sf_dir, "documents"), ["doc_id"])
    assert tokens.count() == 81_331
    assert tokens.select("token").distinct().count() == 18_968
    assert mask_random_tokens(tokens, "doc_id", 42).filter("masked").count() == 12_038


def test_same_seed_same_masks(spark, sf_dir):
    tokens = tokenize(read(spark, sf_dir, "documents"), ["doc_id"])
    first = mask_random_tokens(tokens, "doc_id", 1, epoch=0)
    assert first.exceptAll(mask_random_tokens(tokens, "doc_id", 1, epoch=0)).count() == 0
    assert first.exceptAll(mask_random_tokens(tokens, "doc_id", 1, epoch=1)).count() > 0
    assert first.exceptAll(mask_random_tokens(tokens, "doc_id", 2, epoch=0)).count() > 0


@pytest.mark.parametrize("share, hits", [(0.0, 0), (1.0, 8)])
def test_extreme_shares(text, share, hits):
    masked = mask_random_tokens(tokenize(text, ["doc_id"]), "doc_id", 5, share)
    assert masked.filter("masked").count() == hits


def test_threshold():
    assert share_threshold(0.15) == "26666666"
    with pytest.raises(ValueError):
        share_threshold(1.5)


def test_overlapping_lists_hide_a_word_once(text):
    tokens = tokenize(text, ["doc_id"])
    masked = mask_words_by_lists(tokens, STAND_INS, ["own_a", "own_c"])
    assert masked.count() == tokens.count()
    assert masked.filter("target = 'it'").count() == 1


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_list_and_table_agree(spark, sf_dir, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", rows)
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    tokens = tokenize(read(spark, sf_dir, "documents"), ["doc_id"])
    words = STAND_INS["own_a"] + STAND_INS["own_a"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    by_list = mask_word_tokens(tokens, words)
    by_table = mask_words_by_table(tokens, table, ["doc_id"])
    assert by_list.exceptAll(by_table).count() == 0
    assert by_list.count() == by_table.count()


def test_masks_and_rest_make_all_tokens(text):
    tokens = tokenize(text, ["doc_id"])
    masked = mask_word_tokens(tokens, STAND_INS["own_a"])
    whole = masked.withColumn("token", F.coalesce("target", "token")).drop("target", "masked")
    assert whole.exceptAll(tokens).count() == 0
    assert masked.filter("masked").count() + masked.filter("NOT masked").count() == 8


def test_decoder_rows_stay(text):
    tokens = tokenize(text, ["doc_id"]).withColumn(
        "mode", F.when(F.col("doc_id") == 1, "decoder").otherwise("encoder")
    )
    masked = mask_if_encoder(tokens, lambda t: mask_word_tokens(t, ["it", "a"]))
    assert [r.target for r in masked.filter("masked").collect()] == ["a"]
    assert masked.filter("doc_id = 1 AND (masked OR target IS NOT NULL)").count() == 0


def test_strategies(spark):
    rows = [(d, e, 0, p, "w") for d in range(40) for e in range(2) for p in range(20)]
    tokens = spark.createDataFrame(rows, "doc_id long, epoch int, batch int, pos int, token string")

    def drawn(strategy, epoch):
        masked = redraw_masks(tokens, "doc_id", 9, strategy).filter(f"masked AND epoch = {epoch}")
        return {(r.doc_id, r.pos) for r in masked.collect()}

    assert drawn("once", 0) == drawn("once", 1)
    assert drawn("per_batch", 0) != drawn("per_batch", 1)
    with pytest.raises(ValueError):
        redraw_masks(tokens, "doc_id", 9, "sometimes")


def test_targets_see_masked_neighbours(text):
    rows = mask_targets(text, ["doc_id"], ["it", "is", "the"]).orderBy("pos").collect()
    assert [(r.target, r.left, r.right) for r in rows] == [
        ("it", None, "[MASK]"),
        ("is", "[MASK]", "by"),
        ("the", "by", "sea"),
    ]


def test_rebuilt(text):
    rebuilt = rebuild_text(tokenize(text, ["doc_id"]), ["doc_id"])
    assert {r.doc_id: r.text for r in rebuilt.collect()} == {1: "it is by the sea", 4: "a b c"}


def test_lines_split_into_two_parts(text):
    words = ["sea", "zzz"]
    held = {r.doc_id for r in lines_with_lexicon(text, words).collect()}
    rest = {r.doc_id for r in lines_without_lexicon(text, words).collect()}
    assert (held, rest) == ({1}, {2, 3, 4})


def test_fixed_lists(spark):
    assert sum(len(w) for w in LEXICONS.values()) == 95
    assert len(distinct_words(LEXICONS)) == 81
    lists = {
        name: spark.createDataFrame([(w,) for w in words], "word string")
        for name, words in LEXICONS.items()
    }
    shared = {(r.list_a, r.list_b, r.word) for r in lexicon_overlap(lists).collect()}
    plain = {
        (a, b, w)
        for a in LEXICONS
        for b in LEXICONS
        if a < b
        for w in set(LEXICONS[a]) & set(LEXICONS[b])
    }
    assert shared == plain
    assert ("own_dr", "own_wr", "milk") in shared


def test_tokens_of_takes_columns(text):
    row = text.filter("doc_id = 4").select(tokens_of(F.col("text")).alias("t")).first()
    assert row.t == ["a", "b", "c"]
