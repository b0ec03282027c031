"""SimHash groups, repeated passages and the pipeline against brute force."""

import collections
import random
import re

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from verbena.llm import simhash, suffixes
from verbena.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, bits=3):
    """Least key that links lead to, by key."""
    root = {k: k for k in values}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin((values[a] ^ values[b]) & (2**64 - 1)).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_groups_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    rows = simhash.near_groups(docs).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_groups(prints)


def test_near_pairs_find_every_pair(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for n in (1, 2, 3, 4):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(nodes).collect()}
    expected = {
        (a, b)
        for a in signed
        for b in signed
        if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    }
    assert got == expected


def test_one_of_each_with_odd_rows(spark):
    rows = [
        (5, "a b c d e f g", 1, "x"),
        (3, "A b C d e f g", 1, "y"),
        (3, "A b C d e f g", 1, "y"),
        (None, "a b c d e f g", None, None),
        (7, None, 1, "x"),
        (6, "", 1, "x"),
        (None, "quite another text it is", None, None),
        (8, "word " * 50_000, 1, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, row_hash string")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 3, 6, 8]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    groups = simhash.near_groups(docs).collect()
    assert len(groups) == len(rows)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 300)] + [(7, 7)]
    links += [(500, 400), (400, 450), (450, 500)]
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in out}
    assert len(out) == len(roots)
    assert all(roots[k] == 1 for k in range(1, 41))
    assert all(roots[k] == 100 for k in range(100, 300))
    assert {roots[k] for k in (400, 450, 500)} == {400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts):
    """Words of each document in a repeated run of 50, and those that are not first."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    places = collections.defaultdict(list)
    for k in sorted(words):
        for i in range(len(words[k]) - 49):
            places[tuple(words[k][i : i + 50])].append((k, i))
    found, cut = collections.defaultdict(set), collections.defaultdict(set)
    for own in places.values():
        for n, (k, i) in enumerate(own if len(own) > 1 else []):
            found[k].update(range(i, i + 50))
            if n:
                cut[k].update(range(i, i + 50))
    return dict(found), dict(cut)


def spans_found(spans):
    found, cut = collections.defaultdict(set), collections.defaultdict(set)
    for r in spans.collect():
        found[r["doc_id"]].update(range(r["start"], r["end"]))
        for c in r["cuts"]:
            cut[r["doc_id"]].update(range(c["start"], c["end"]))
    return dict(found), dict(cut)


def passages(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 75, 140)]
    out = {}
    for k in range(60):
        own = text(rng.randrange(0, 90))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            own += s + text(rng.randrange(0, 30))
        out[k] = " ".join(own)
    out[60] = out[61] = out[3]
    out[62] = " ".join(["same"] * 200)
    out[63] = ""
    return out


def test_repeated_passages(spark, monkeypatch):
    texts = passages()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    expected = brute_repeats(texts)
    assert spans_found(suffixes.repeated_spans(docs)) == expected
    # The way of frequent anchors gives the same.
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(suffixes, "SAMPLE", 1)
    assert spans_found(suffixes.repeated_spans(docs)) == expected


def test_repeated_passages_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert spans_found(suffixes.repeated_spans(docs)) == brute_repeats(texts)


def test_cut_repeats_with_odd_rows(spark):
    run = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, f"start  here {run}\nend", "s"),
        (2, f"other {run} tail", "s"),
        (None, run, None),
        (3, None, "s"),
        (4, "", "s"),
        (2, f"other {run} tail", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts string")
    out = suffixes.cut_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 9), r["text"]) for r in out.collect() if r["text"] is not None)
    assert got == [
        (1, f"start  here {run}\nend"),
        (2, "other tail"),
        (2, "other tail"),
        (4, ""),
        (9, ""),
    ]
    assert suffixes.cut_repeats(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        tables.append(docs)
    cleaned, unique, cut, masked, packed = tables
    assert all(t.columns == columns for t in tables[:-1])
    # Near duplicates: the least id of each group of similar texts of the stage before.
    kept = {r["doc_id"] for r in unique.collect()}
    assert kept == brute_kept({r["doc_id"]: r["text"] for r in cleaned.collect()})
    # Repeats: what is left of the words.
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    gone = brute_repeats(texts)[1]
    for r in cut.collect():
        own = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        left = [w for k, w in enumerate(own) if k not in gone.get(r["doc_id"], ())]
        assert re.findall(r"[^\x20\x09-\x0D]+", r["text"]) == left
        assert r["n_chars"] == len(r["text"])
    assert masked.count() == len(kept)
    assert masked.filter(F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept
