"""Collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

from verbena.llm import phrases

SCHEMA = "doc_id long, text string, lang string, shard int, n long, word string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, longest=3, support=10, first=2000):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    own[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        best = []
        for p, a in cands.items():
            inside = [
                b
                for q, b in cands.items()
                if len(q) > len(p)
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= 50 * a for b in inside):
                continue
            score, k = min(
                (10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))
            )
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def sentences(seed, count):
    rng = random.Random(seed)
    words = ["New", "york", "city", "hall", "the", "of", "É", "ünd", "a", "b", "c'd", "#x"]
    fixed = ["New York City", "of the\ta", "É  ünd #x c'd"]
    rows = []
    for k in range(count):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words))
            parts.append(rng.choice([" ", "  ", " ", ", ", ".", "\n", "\x0b", "\t", "\xa0"]))
        rows.append((k, "".join(parts), rng.choice(["en", "en", "en", "de", None, "und"]), 1, 2, "z"))
    return rows


def test_against_counting(spark):
    rows = sentences(5, 400)
    expected = brute(rows)
    assert len(expected) > 30 and {r[0] for r in expected} == {"en", "de", "und"}
    assert found(spark, rows) == expected


def test_many_buckets_and_a_full_bitmap(spark, monkeypatch):
    rows = sentences(6, 300)
    monkeypatch.setattr(phrases, "BUCKET_PHRASES", 64)
    assert found(spark, rows, shards=1) == brute(rows)
    # A bitmap far too small lets everything pass and changes nothing.
    monkeypatch.setattr(phrases, "MOST_BLOCKS", 1)
    monkeypatch.setattr(phrases, "BITS_A_PHRASE", 1)
    assert found(spark, rows, shards=7) == brute(rows)


def test_longer_phrases_and_other_limits(spark):
    rows = sentences(7, 250)
    assert found(spark, rows, longest=4, support=6, first=9) == brute(rows, 4, 6, 9)


def test_odd_rows(spark):
    rows = [
        (1, None, "en", 1, 2, "z"),
        (2, "", None, 1, 2, "z"),
        (3, " .,; \t\n", "de", 1, 2, "z"),
        (4, "one two " * 30_000, None, 1, 2, "z"),
        (4, "one two " * 30_000, None, 1, 2, "z"),
        (None, "Same same SAME " * 9, "xx", None, None, None),
        (6, "x" * 100_000, "en", 1, 2, "z"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, rows[:3]) == []


def test_scores_beyond_64_bits(spark):
    a, l, r = 9 * 10**14 + 7, 10**15 + 9, 9 * 10**14 + 11
    from pyspark.sql import functions as F

    score = phrases.score_of(F.lit(a), F.lit(l), F.lit(r))
    assert spark.range(1).select(score).first()[0] == 10**6 * a * a // (l * r)
