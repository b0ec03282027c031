"""Near copies of the pipeline's stage against brute-force Jaccard similarity."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from verbena.llm import near_copies, quality, simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """The least id of each group that links of similarity 0.8 and more make."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * every:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(k) for k in ids}


def kept(docs):
    return sorted(r["doc_id"] for r in docs.collect())


def edited(seed=11):
    """Texts and copies of them, and copies of copies, with a few words changed."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 900))] for _ in range(40)]
    for _ in range(160):
        own = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 2 + len(own) // 40)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(own)
    rng.shuffle(texts)
    return {k: " ".join(t) for k, t in enumerate(texts)}


def test_edited_copies(spark):
    texts = edited()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    expected = brute_kept(texts)
    assert kept(left) == sorted(expected) and len(expected) < 120


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cleaned = quality.clean_documents(docs)
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert kept(corpus_pipeline.near_duplicates(spark, cleaned, sf_dir)) == sorted(brute_kept(texts))


def test_a_star_of_copies(spark):
    """Copies that are near one text but not near each other."""
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words))]
    for k in range(1, 56):
        rows.append((k, " ".join([*words[:k], "other", *words[k + 1 :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(near_copies.one_of_each(docs)) == sorted(brute_kept(dict(rows)))


def test_odd_rows(spark):
    rows = [
        (5, "a b c d e f g", 1, "x"),
        (3, "A b  C d e f g", 1, "y"),
        (3, "A b  C d e f g", 1, "y"),
        (None, "a b c d e f g", None, None),
        (7, None, 1, "x"),
        (6, "", 1, "x"),
        (None, "quite another text it is", None, None),
        (8, "word " * 50_000, 1, "z"),
        (9, "two words", 1, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, row_hash string")
    left = near_copies.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 3, 6, 8, 9]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def star(leaves, edits, seed=2):
    """A text and copies of it, each with a few words of its own, near it but not near each other."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(words))]
    for k in range(1, leaves + 1):
        own = list(words)
        for place in rng.sample(range(150), rng.randrange(1, edits + 1)):
            own[place] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    return rows


def test_a_large_star_is_not_compared_in_pairs(spark, monkeypatch):
    compared = []
    similar = near_copies.similar

    def counted(pairs, sets, least):
        compared.append(pairs.count())
        return similar(pairs, sets, least)

    monkeypatch.setattr(near_copies, "similar", counted)
    rows = star(600, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert kept(near_copies.one_of_each(docs)) == sorted(brute_kept(dict(rows)))
    assert sum(compared) < 10_000


def test_fingerprints_find_links_of_their_own(spark, monkeypatch):
    """Without a min-hash key in common, copies that op1's fingerprints bring together are still one."""
    marks, none = near_copies.marks, F.array().cast("array<bigint>")
    monkeypatch.setattr(near_copies, "marks", lambda text, size: marks(text, size).withField("keys", none))
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = {k: [rng.choice(words) for _ in range(900)] for k in range(12)}
    for k in range(12):
        texts[100 + k] = [*texts[k][:450], "new", *texts[k][451:]]
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = {k: simhash.fingerprint(t.encode()) for k, t in rows}
    near = {k for k in range(12) if ((prints[k] ^ prints[100 + k]) & (2**64 - 1)).bit_count() <= 3}
    assert len(near) >= 6
    left = kept(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert left == sorted({*range(12), *(100 + k for k in range(12) if k not in near)})


def test_a_group_of_fingerprints_is_checked(spark, monkeypatch):
    """Texts of one fingerprint but few common shingles stay, and a large group is a row for each node."""
    sizes = []
    similar = near_copies.similar

    def counted(pairs, sets, least):
        sizes.append(pairs.count())
        return similar(pairs, sets, least)

    monkeypatch.setattr(near_copies, "similar", counted)
    monkeypatch.setattr(near_copies, "fingerprints", lambda text: F.lit(5).cast("long"))
    rows = [(k, " ".join(f"w{k // 2}x{i}" for i in range(40)) + (" end" if k % 2 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kept(near_copies.one_of_each(docs)) == sorted(brute_kept(dict(rows))) == list(range(0, 60, 2))
    assert sizes[0] == 59 and sum(sizes) < 200
