"""Tokens, packing, toxicity and neighbours: exact round trips, brute force, held-out accuracy."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verbena.llm import bpe_chunks, nn_descent, packing, toxicity
from verbena.llm.units import units_of

ODD = [
    "",
    " ",
    "  <|endoftext|> x<|startoftext|>y <|endoftext|>\n\n",
    "’quotes“ café naïve é ́x 中文字符 日本語テスト 한국어 \x1c\x1d x\x85y　z",
    "don't we'll " * 500,
    "x" * 5000,
    "1234567890" * 400,
    "ΑΣ Σ ΣΑΣ. ΟΔΟΣ " * 300,
    "a\t\tb\r\n c  \n" * 700,
    "𝔘𝔫𝔦 ½²³ªº ÀÉ ß" * 50,
]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def texts_of(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name", FILES)
def test_chunks_agree_with_tokenizer(spark, sf_dir, name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    store = bpe_chunks.ChunkStore(units_of(path))
    decode = bpe_chunks.decoder(store.units)
    for text in [*texts_of(spark, sf_dir)[:100], *ODD]:
        ids = np.frombuffer(store.ids(text.encode()), "<u4").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids
        assert decode(ids) == plain.decode(ids, skip_special_tokens=False)
        assert b"".join(bpe_chunks.chunks(text.encode())) == text.encode()


def test_chunks_are_shared():
    rng = np.random.default_rng(1)
    shared = " ".join(f"w{k}" for k in rng.integers(0, 9999, 3000)).encode()
    one, two = (b" ".join([str(k).encode(), shared, b"end"]) for k in (1, 22222))
    both = set(bpe_chunks.chunks(one)) & set(bpe_chunks.chunks(two))
    assert sum(map(len, both)) > 0.6 * len(shared)


def test_encode_documents_with_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(None, None, 1), (0, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch int")
    outputs = ["ids", "decoded", "n_tokens", "ids_sha256"]
    out = bpe_chunks.encode_documents(docs, path, outputs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else ""
        ids = plain.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == plain.decode(ids, skip_special_tokens=False)
    assert bpe_chunks.encode_documents(docs.limit(0), path, outputs).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = {k: "some words here " * (k * 7 % 400) for k in range(200)} | {300: "x y " * 4000}
    rows = [(k, t, 0) for k, t in texts.items()] + [(0, "", 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = packing.pack(packing.piece_rows(docs, path, with_ids=True)).collect()
    by_sequence = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for key, text in texts.items():
        if key == 0:
            continue
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        own = sorted(pieces[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 1024 for r in own[1:])
        joined = b"".join(bytes(r["ids"]) for r in own)
        assert joined == np.array(ids, "<u4").tobytes()
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in own)
        assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own[:-1]]]))
    assert len(pieces[0]) == 2 and len(pieces[None]) == 1
    least = -(-sum(r["length"] for r in out) // 1024)
    assert len(by_sequence) <= 1.05 * least + 1
    assert packing.pack(packing.piece_rows(docs.limit(0), path)).count() == 0


def test_equal_rows_are_dealt_out(spark, monkeypatch, tmp_path):
    """Many pieces without an id and of one text: each has its own number, in chunks of bounded size."""
    monkeypatch.setattr(packing, "CHUNK", 50)
    rows = spark.range(0, 3000, 1, 7).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(0).alias("piece"),
        F.when(F.col("id") % 3 == 0, 900).otherwise(100).cast("long").alias("length"),
    )
    rows.write.parquet(str(tmp_path / "pieces"))
    counts = {900: 1000, 100: 2000}
    out = packing.numbered(spark.read.parquet(str(tmp_path / "pieces")), counts)
    for length, n in counts.items():
        own = out.filter(F.col("length") == length)
        assert sorted(r["number"] for r in own.select("number").collect()) == list(range(n))
        assert own.groupBy("chunk").count().agg(F.max("count")).first()[0] < 100
    packed = packing.pack(rows)
    assert packed.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert packed.select("sequence_id", "offset").distinct().count() == 3000
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_two_replace_the_shortest():
    # Greedy takes 6 and 3 of 10; 2 and 2 fill the room of the 3 better.
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
    plan = packing.plan_bins({5: 1000, 4: 10, 1024: 7}, 1024)
    counts = collections.Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for x in lengths:
            counts[x] += times
    assert counts == {5: 1000, 4: 10, 1024: 7}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    more = docs.unionByName(
        spark.createDataFrame(
            [(None, None, None, None, None), (5000, "", "en", "s", 0), (5000, "", "en", "s", 0)],
            docs.schema,
        )
    )
    model = toxicity.train(more, labels)
    rows = toxicity.score_toxicity(more, model).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        expected = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == expected
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_training_takes_every_row(spark, monkeypatch):
    """A word and a language that only rows behind the first 2,000 of their class hold."""
    monkeypatch.setattr(toxicity, "SHARD", 3000)  # several shards
    ids = spark.range(16_000).select(F.col("id").alias("doc_id"), toxicity.remainder(F.col("id")).alias("part"))
    listed = ids.withColumn("at", F.xxhash64("doc_id", F.lit("sample"))).orderBy("at").collect()
    part = {k: [r["doc_id"] for r in listed if (r["part"] == 1) == (k == 1) and r["part"] != 0] for k in (1, 2)}
    late = set(part[1][-400:]) | set(part[2][-400:])
    rng = np.random.default_rng(6)
    rows = []
    for r in listed:
        k, toxic = r["doc_id"], int(r["doc_id"] in late or rng.random() < 0.75)
        bad = "zonk" if k in late else "vile" if toxic else "fine"
        rows.append((k, " ".join([*rng.choice(list("abcdefgh"), 5), bad]), "rare" if k in late else "en", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(5)
    assert sum(r[3] for r in rows if r[0] in set(part[1][:-400])) > 2000
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert set(model.thresholds) == {"en", "rare"}
    scorer = toxicity.Scorer(model)
    assert [scorer.score(f"a b c {w}") >= 0.5 for w in ("zonk", "vile", "fine")] == [True, True, False]


def test_rounds_read_no_text(spark, monkeypatch):
    """Words are found once, however many rounds there are, and the rounds move the model as they do from texts."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{k}" for k in "abcdéfgh"], 9)) for _ in range(150)]
    rows = [(0, t, int("wa wb" in t)) for t in [*texts, ""]]
    table = spark.createDataFrame(rows, "shard int, text string, toxic int").coalesce(1)
    read, plain = [], type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda df, *rest: read.append(df.columns) or plain(df, *rest))
    model = toxicity.fit_shards(table, 0.5)
    assert len(read) == toxicity.EPOCHS + 1 and sum("text" in columns for columns in read) == 1
    by_hand = toxicity.Trainer(toxicity.Model.new())
    for epoch in range(toxicity.EPOCHS):
        parts = toxicity.shard_moves(by_hand, toxicity.RATE / (1 + epoch), iter(rows)).rows()
        toxicity.move(by_hand, {k: np.frombuffer(sums, np.float32).astype(float) for k, sums in parts})
    assert np.array_equal(model.embed, by_hand.model.embed) and model.shift == by_hand.model.shift
    assert all(np.array_equal(a, b) for a, b in zip(model.filters, by_hand.model.filters, strict=True))


def test_batches_of_a_shard_stay_together(spark, tmp_path):
    """Reading splits no shard, even where the session writes small row groups and reads small parts of files."""
    rng = np.random.default_rng(9)
    rows = [(k // 8000, " ".join(rng.choice([f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"], 20)), 0) for k in range(16_000)]
    spark.createDataFrame(rows, "shard int, text string, toxic int").coalesce(1).write.parquet(str(tmp_path / "rows"))
    hadoop, key = spark.sparkContext._jsc.hadoopConfiguration(), "spark.sql.files.maxPartitionBytes"
    hadoop.setInt("parquet.block.size", 1 << 15)
    try:
        table = toxicity.coded_table(spark.read.parquet(str(tmp_path / "rows")))
        spark.conf.set(key, 1 << 15)
        parts = table.withColumn("part", F.spark_partition_id()).select("shard", "part").distinct().collect()
        assert table.rdd.getNumPartitions() > 2 and len(parts) == 2
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset(key)


def test_batches_as_rows():
    """A batch comes back from its row, with few and with over 65,536 words."""
    for n in (0, 1, 70_000):
        words = toxicity.Words()
        coded = words.codes([" ".join(f"{chr(97 + k % 26)}{'x' * (k % 7)}{chr(0x4E00 + k // 182)}" for k in range(n)), "a b a"])
        batch = toxicity.Coded.of(coded, words.buckets, np.array([1.0, 0.0]))
        again = toxicity.Coded.from_row(*batch.row())
        assert len(batch.buckets) >= n
        for name in ("places", "sizes", "buckets", "labels"):
            assert np.array_equal(getattr(batch, name), getattr(again, name))


def test_features_against_plain_checksums():
    letters = ["a", "b", "z", "é", "ß", "中", "𝔘"]
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(letters, n)) for n in [*range(1, 45), 5000] for _ in range(5)]
    words += ["x" * n for n in range(30, 36)]
    plain = [
        [zlib.crc32(part.encode()) % toxicity.BUCKETS for part in ("w" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "e" + w[-4:])]
        for w in words
    ]
    assert toxicity.features_of(words).tolist() == plain
    assert [toxicity.features(w) for w in words] == plain
    assert toxicity.features_of([]).shape == (0, 5)


def test_texts_are_scored_together_as_alone(monkeypatch):
    texts = ["", "one", "one two", "Straße é 中文 x1y2", "a b c d e f g " * 50, "", "two one", ""]
    scorer = toxicity.Scorer(toxicity.fit(texts * 4, np.array([0, 1, 0, 1, 1, 0, 1, 0] * 4, float), 0.4))
    alone = [scorer.score(t) for t in texts]
    for group in (1, 3, 1000):
        monkeypatch.setattr(toxicity, "GROUP", group)
        assert list(scorer.scores(texts)) == pytest.approx(alone, abs=1e-6)
    assert list(scorer.scores([])) == []


def test_every_shard_moves_the_model():
    """The moves of two shards, added up as Spark does, against two runs by hand."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{k}" for k in "abcdefgh"], 9)) for _ in range(80)]
    rows = [(k % 2, t, int("wa wb" in t)) for k, t in enumerate(texts)]
    rows.sort(key=lambda r: r[0])
    start = toxicity.Trainer(toxicity.Model.new())
    ends = [toxicity.Trainer(toxicity.Model.new()) for _ in range(2)]
    for k, end in enumerate(ends):
        own, words = [r for r in rows if r[0] == k], toxicity.Words()
        for at in range(0, len(own), toxicity.BATCH):
            batch = own[at : at + toxicity.BATCH]
            coded = words.codes([t for _, t, _ in batch])
            end.step(coded, words.buckets, np.array([y for *_, y in batch], float), 0.01)
    parts = [dict(toxicity.shard_moves(start, 0.01, iter(half)).rows()) for half in (rows[:40], rows[40:])]
    sums = {k: sum(np.frombuffer(p[k], np.float32).astype(float) for p in parts) for k in parts[0]}
    held = [end.drift.any(axis=1) for end in ends]
    first = toxicity.Model.new().embed
    toxicity.move(start, sums)
    for b in range(toxicity.BUCKETS):
        own = [end.model.embed[b] for end, h in zip(ends, held, strict=True) if h[b]]
        assert np.allclose(start.model.embed[b], np.mean(own, axis=0) if own else first[b], atol=1e-6)
    for p, *own in zip(start.params, *[end.params for end in ends], strict=True):
        assert np.allclose(p, np.mean(own, axis=0), atol=1e-6)
    assert start.model.shift == pytest.approx(np.mean([end.model.shift for end in ends]), abs=1e-6)


def test_thresholds_against_every_cut(spark):
    rng = np.random.default_rng(8)
    rows = [(lang, int(rng.random() < 0.3), float(rng.integers(0, 40)) / 40) for lang in ("a", "b", "") for _ in range(90)]
    rows += [("none", 0, 0.9), ("one", 1, 0.3)]
    scored = spark.createDataFrame(rows, "lang string, toxic int, score double").repartition(4)
    found = {r["lang"]: r["threshold"] for r in toxicity.best_thresholds(scored).collect()}
    expected = {}
    for lang in (None, "a", "b", "", "one"):
        own = [(s, y) for x, y, s in rows if lang is None or x == lang]
        cuts = sorted({s for s, _ in own}, reverse=True)
        every = sum(y for _, y in own)
        f1 = [2 * sum(y for s, y in own if s >= c) / (sum(s >= c for s, _ in own) + every) for c in cuts]
        at = int(np.argmax(f1))
        expected[lang] = (cuts[at] + (cuts[at + 1] if at + 1 < len(cuts) else 0)) / 2
    assert found == pytest.approx(expected)


def plain_score(model, text):
    """The classifier as a plain loop over places, filters and components."""
    words = [model.embed[toxicity.features(w)].sum(axis=0).astype(float) for w in toxicity.words_in(text)]
    words += [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - len(words))
    out = float(model.shift)
    for f, width in enumerate(toxicity.WIDTHS):
        for k in range(toxicity.FILTERS):
            best = max(
                sum(float(words[at + j] @ model.filters[f][j][:, k]) for j in range(width))
                for at in range(len(words) - width + 1)
            )
            column = f * toxicity.FILTERS + k
            out += max(best + float(model.bias[column]), 0) * float(model.weight[column])
    return 1 / (1 + np.exp(-out))


def test_scores_against_a_plain_loop():
    texts = ["", "one", "one two", "You are so one two three " * 3, "Straße é 中文 x1y2", "a b c d e f g " * 50]
    model = toxicity.fit(texts * 4, np.array([0, 1, 0, 1, 1, 0] * 4, float), 0.4)
    scorer = toxicity.Scorer(model)
    for text in [*texts, "words never seen before", "two one"]:
        assert scorer.score(text) == pytest.approx(plain_score(model, text), abs=1e-4)


def test_training_separates_a_phrase():
    """A pair of words is learnt, not its words: only filters of width two or more tell them apart."""
    rng = np.random.default_rng(3)
    filler = [f"w{k}x" for k in "abcdefghij"]
    texts, labels = [], []
    for _ in range(300):
        words = list(rng.choice(filler, 12))
        at = int(rng.integers(0, 11))
        words[at : at + 2] = ("bad", "thing") if len(texts) % 2 else ("thing", "bad")
        texts.append(" ".join(words))
        labels.append(float(len(texts) % 2 == 0))
    scorer = toxicity.Scorer(toxicity.fit(texts, np.array(labels), 0.5))
    assert np.mean([(scorer.score(t) >= 0.5) == y for t, y in zip(texts, labels, strict=True)]) > 0.9


def test_sample_is_bounded(spark):
    rows = [(k, "x" * (k % 7 * 10), "en", 1) for k in range(400)]
    rows += [(k, "é" * 500_000, "en", 1) for k in (1, 2, 3)] + [(5, None, None, 1)] * 50 + [(None, "t", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(7, 0), (None, 1)], "doc_id long, toxic int")
    usable = labels.filter(toxicity.remainder(F.col("doc_id")) != 0)
    got = toxicity.sampled(docs, usable, 30, 1000).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["toxic"], r["held"]].append(r)
        part = zlib.crc32(str(r["doc_id"]).encode()) % 5
        assert r["toxic"] == r["doc_id"] % 2 and part != 0 and r["held"] == (part == 1)
    assert len(groups) == 4
    for own in groups.values():
        assert 0 < len(own) <= 30 and sum(len(r["text"].encode()) for r in own) <= 1000
        assert len({r["doc_id"] for r in own}) == len(own)
    every = toxicity.sampled(docs, usable, 400, 1 << 40).collect()
    assert len(every) == usable.filter("doc_id is not null").select("doc_id").distinct().count()


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 700)] + 0.4 * rng.normal(size=(700, 16))
    vectors[::3] *= rng.uniform(0.5, 2, (len(vectors[::3]), 1))  # norms differ
    vectors[100:160] = vectors[100]  # copies
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(vectors.astype(np.float32))]
    odd = [
        (1001, None, 1),
        (1002, [0.0] * 16, 1),
        (1003, [float("nan")] + [1.0] * 15, 1),
        (1004, [None] + [1.0] * 15, 1),
        (1005, [1.0, 2.0], 1),
        (None, [1.0] * 16, 1),
        rows[7],
    ]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node int")
    out = nn_descent.nearest_neighbours(table, lambda i: F.pmod(i, F.lit(20)) == 0).collect()
    found = collections.defaultdict(dict)
    for r in out:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    exact = vectors.astype(np.float32).astype(np.float64)
    hits = 0
    assert sorted(found) == list(range(0, 700, 20))
    for q, own in found.items():
        scores = exact @ exact[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(700), -scores))[:20]
        assert sorted(own) == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for v, s in own.values())
        hits += len({int(x) for x in best} & {v for v, _ in own.values()})
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("case", ["huge", "offset", "lengths"])
def test_recall_on_hard_tables(spark, case):
    """One vector of a thousand times the norm, a common offset, and vectors of two lengths."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if case == "huge":
        vectors[777] *= 1000
    if case == "offset":
        vectors += 3
    short = rng.normal(size=(30, 3)) if case == "lengths" else np.zeros((0, 3))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([*vectors, *short])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nn_descent.nearest_neighbours(table, lambda i: i % 20 == 0).collect()
    found = collections.defaultdict(set)
    for r in out:
        found[r["query_id"]].add(r["vec_id"])
    hits = wanted = 0
    for q in range(0, len(rows), 20):
        own, first = (vectors, 0) if q < 1500 else (short, 1500)
        scores = own @ own[q - first]
        scores[q - first] = -np.inf
        best = {first + int(x) for x in np.lexsort((np.arange(len(own)), -scores))[:20]}
        hits, wanted = hits + len(best & found[q]), wanted + 20
        assert len(found[q]) == 20 and all((v >= 1500) == (q >= 1500) for v in found[q])
    assert hits >= 0.95 * wanted


def test_neighbours_of_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    out = nn_descent.nearest_neighbours(few, lambda i: i == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(1, 0.5), (2, 0.5)]
    assert nn_descent.nearest_neighbours(few.limit(0), lambda i: i == 0).count() == 0
