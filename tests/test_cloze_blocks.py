"""Sums over a vocabulary by blocks and slices against joins on pairs and plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.operators import cloze
from verbena.operators.cloze import cloze_chances, cloze_tables, sums_by_blocks, sums_by_joins
from verbena.operators.language import contexts_of_pairs, fit_unigram, pair_counts, words_of_pairs
from verbena.operators.tokens import neighbours
from verbena.session import CLEANUP_KEY, written

PARTS = ["train", "base"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = [(rng.choice(PARTS), " ".join(rng.choices("abcdefgh", range(1, 9), k=20))) for _ in range(30)]
    near = neighbours(spark.createDataFrame(rows, "part string, text string"), ["part"])
    pairs = written(pair_counts(near, "part", PARTS), "pairs")
    words = written(fit_unigram(words_of_pairs(pairs, PARTS), PARTS), "words")
    return pairs, words, written(contexts_of_pairs(pairs, PARTS), "contexts")


@pytest.mark.parametrize("block, slice_, step", [(2_000_000, 4_000_000, 4_000_000), (3, 7, 2)])
def test_blocks_equal_joins_and_loops(spark, tables, monkeypatch, block, slice_, step):
    for name, value in (("BLOCK", block), ("SLICE", slice_), ("STEP", step)):
        monkeypatch.setattr(cloze, name, value)
    known = cloze_tables(*tables, PARTS)
    letters = list("abcdefgh") + ["unheard"]
    asked = spark.createDataFrame([(x, y) for x in letters for y in letters], "left string, right string")
    n = {p: {(r.prev, r.token): r[f"n_{p}"] for r in tables[0].collect()} for p in PARTS}
    led = {p: {r.prev: r[f"context_{p}"] + 10 for r in tables[2].collect()} for p in PARTS}
    for sums in (sums_by_blocks, sums_by_joins):
        got = {(r.left, r.right): r for r in sums(asked, known, PARTS).collect()}
        for x in letters:
            for y in letters:
                for p in PARTS:
                    plain = sum(n[p].get((x, w), 0) * n[p].get((w, y), 0) / led[p].get(w, 10) for w in "abcdefgh")
                    mine = got[x, y][f"both_{p}"] if (x, y) in got else 0
                    assert mine == pytest.approx(plain)


def test_no_row_for_each_slot_and_candidate(spark, tables, monkeypatch):
    """Slots between the same neighbours ask once."""
    asked = []
    monkeypatch.setattr(cloze, "sums_by_blocks", lambda rows, *rest: asked.append(rows) or sums_by_blocks(rows, *rest))
    rows = [("a", w, "b", k) for w in "cdef" for k in range(10)] + [(None, "a", "b", 0), ("a", "b", None, 0)]
    slots = spark.createDataFrame(rows, "left string, target string, right string, n int")
    assert cloze_chances(slots, *tables, PARTS).count() == 42
    assert [tuple(r) for r in asked[0].collect()] == [("a", "b")]
    assert asked[0].filter(F.col("left") == "").count() == 0


def test_asked_rows_do_not_move(spark, tables, monkeypatch):
    """Blocks get packed pairs; asked rows, once for each block before, stay out of the shuffle to them."""
    made, kept = [], cloze.written
    monkeypatch.setattr(cloze, "written", lambda df, label: made.append((label, df)) or kept(df, label))
    monkeypatch.setattr(cloze, "BLOCK", 3)
    known = cloze_tables(*tables, PARTS)
    letters = list("abcdefgh")
    asked = spark.createDataFrame([(x, y) for x in letters for y in letters], "left string, right string")
    assert sums_by_blocks(asked, known, PARTS).count() == 64
    assert "met" not in [label for label, _ in made]
    [summed] = [df for label, df in made if label == "sums"]
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert "FlatMapGroupsInArrow" not in plan and "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("often, cells", [(1, 4), (1, 1_000), (3, 40), (10**9, 1)])
def test_tables_and_bisection_give_the_same_sums(monkeypatch, often, cells):
    monkeypatch.setattr(cloze, "OFTEN", often)
    monkeypatch.setattr(cloze, "CELLS", cells)
    monkeypatch.setattr(cloze, "STEP", 5)
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(-(2**63), 2**63 - 1, 20))

    def entries():
        at = rng.choice(7 * len(words), 60, replace=False)
        return [words[at % len(words)], at // len(words), rng.integers(0, 4, 60)]

    divisor = rng.random(len(words)) + 1
    held = {0: [words, divisor.view(np.int64)], 1: entries(), 2: entries()}
    left, right = np.repeat(np.arange(7), 7), np.tile(np.arange(7), 7)
    sums = np.zeros((1, 49))
    cloze._add_block(sums, (np.arange(7), np.arange(7), left, right, np.arange(49)), held)
    dense = [np.zeros((7, len(words))) for _ in range(2)]
    for table, (word, near, n) in zip(dense, (held[1], held[2]), strict=True):
        table[near, np.searchsorted(words, word)] = n
    assert sums[0] == pytest.approx(((dense[0] / divisor) @ dense[1].T).ravel())


def test_packed_entries_come_back():
    rng = np.random.default_rng(4)
    columns = [np.sort(rng.integers(-(2**63), 2**63 - 1, 500)), rng.integers(0, 70_000, 500), np.zeros(500, np.int64)]
    columns.append(rng.random(500).view(np.int64))
    columns[0][:2] = -(2**63), 2**63 - 1
    columns[0].sort()
    for size in (1, 2, 500):
        some = [c[:size] for c in columns]
        back = cloze._unpacked(cloze._packed(some))
        assert [x.tolist() for x in back] == [x.tolist() for x in some]
    assert len(cloze._packed(columns[:3])) < 500 * 13


def test_pairs_of_slots_keep_all_that_slots_need(spark, tables):
    rows = spark.createDataFrame([("a", "b", ""), ("", "c", "d"), ("e", "f", "g")], "left string, target string, right string")
    got = {(r.prev, r.token) for r in cloze.pairs_of_slots(rows, tables[0]).collect()}
    every = {(r.prev, r.token) for r in tables[0].collect()}
    need = {("a", "b"), ("c", "d"), ("e", "f"), ("f", "g")} & every
    assert need <= got and len(got) < len(every) / 2


def test_written_leaves_no_shuffle_files(spark):
    """What a written table shuffled is gone from the disks when it is written."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def names():
        return {name for name in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before = spark.conf.get(CLEANUP_KEY, None)
    held = names()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    end = time.time() + 20
    while names() - held and time.time() < end:
        time.sleep(0.1)
    assert not names() - held
    assert table.count() == 7 and spark.conf.get(CLEANUP_KEY, None) == before


def test_pair_counts_keep_any_words(spark):
    rows = [("a b", "c", "x"), ("a", "b c", "x"), (None, "1 a", "y"), ("", "1 a", "x"), ("é", "ü", "y"), ("é", "ü", "y")]
    near = spark.createDataFrame(rows, "prev string, token string, part string")
    got = sorted(tuple(r) for r in pair_counts(near, "part", ["x", "y"]).collect())
    assert got == [("", "1 a", 1, 1), ("a", "b c", 1, 0), ("a b", "c", 1, 0), ("é", "ü", 0, 2)]
