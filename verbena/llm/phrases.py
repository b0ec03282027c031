"""Phrases whose words stand together more often than chance, by the SON partitioning.

A language's texts are dealt to ``SHARDS`` shards by a hash of the text. A phrase that occurs ``support``
times in the language has, in some shard, at least its share of that: support times the shard's words over
all words, rounded up. So each shard is mined completely at that lower support, the phrases frequent in
any shard are the only ones that can be frequent, and a second pass counts those exactly.

Every pass reads the texts in batches of a million words; a batch counts its own phrases before anything is
sent. While a shard is mined, a phrase is a hash: equal hashes of different phrases add up, which
can only add a candidate. Hashes are dealt to buckets by their first bits, as many as the corpus asks for,
and a bucket holds 32 further bits of each, so no task needs a whole language or shard. Candidates become a
bitmap of at most 16 MB that the second pass asks; what passes by chance is counted by its words
like all else and falls below the support. So the counts, and the result, are exact at any size.

The support is absolute, so a shard must hold more than a tenth of a language to have a lower
support above one, and each further shard lets more phrases pass: on 0.1 GB of documents 1,240,000
with four shards and 518,000 with two, where 234,000 are frequent. Hence few shards, each
spread over many tasks, rather than one for each task.

Defined cases of :func:`collocations`. A null or empty text has no words, a null language is ``und``.
Repeated rows count as often as they stand. Only A-Z are lower-cased. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.support import ship, text_of
from verbena.operators.joins import lookup
from verbena.session import written

SHORTEST = 2  # words of a phrase
LONGEST = 3
SUPPORT = 10
SHARDS = 2
COVERED = 50  # percent of a phrase's occurrences in a longer one that drop it
FIRST = 2000  # phrases reported for a language
DEALS = 16  # parts of a language that are ranked by themselves first

BATCH_WORDS = 1_000_000
BUCKET_PHRASES = 1 << 22  # phrases, repeats included, that a bucket of hashes is made for
BLOCK_BITS = 16  # bits of the place within a block of the bitmap
MOST_BLOCKS = 1 << 11  # 16 MB of bitmap
BITS_A_PHRASE = 16

BREAK = 0  # stands between two pieces
NOTHING = 1  # between two blanks
_TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = a * _K1 + b
    x = (x ^ (x >> np.uint64(32))) * _K2
    return x ^ (x >> np.uint64(29))


class Vocabulary(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Batch:
    """The words of a batch of texts as numbers, by group (language, shard)."""

    def __init__(self) -> None:
        self.vocabulary = Vocabulary({b"\n": BREAK, b"": NOTHING})
        self.groups: dict[tuple, list[np.ndarray]] = {}
        self.size = 0

    def add(self, group: tuple, text: bytes) -> None:
        spaced = text.lower().translate(_TABLE).replace(b"\n", b" \n ")
        numbers = np.array([self.vocabulary[w] for w in spaced.split(b" ")] + [BREAK], np.int64)
        numbers = numbers[numbers != NOTHING]
        self.groups.setdefault(group, []).append(numbers)
        self.size += len(numbers)

    def texts(self) -> Iterator[tuple[tuple, np.ndarray]]:
        for group, parts in self.groups.items():
            yield group, np.concatenate(parts)

    def words(self) -> list[bytes]:
        return list(self.vocabulary)

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))


def batches(tables: Iterator[pa.RecordBatch], size: int = BATCH_WORDS) -> Iterator[Batch]:
    """Batches out of rows of (lang, shard, value)."""
    batch = Batch()
    for table in tables:
        columns = [table.column(c).to_pylist() for c in ("lang", "shard")]
        for lang, shard, text in zip(*columns, table.column("value")):
            batch.add((lang, shard), text.as_py())
            if batch.size >= size:
                yield batch
                batch = Batch()
    if batch.size:
        yield batch


def phrase_hashes(
    numbers: np.ndarray, words: np.ndarray, lang: str, longest: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of all phrases of each length and their hashes."""
    import xxhash

    seed = np.full(1, xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    starts = np.flatnonzero(numbers != BREAK)
    hashed = mixed(seed, words[numbers[starts]])
    for length in range(2, longest + 1):
        ends = starts + length - 1
        whole = ends < len(numbers)
        whole[whole] = numbers[ends[whole]] != BREAK
        starts, hashed = starts[whole], hashed[whole]
        hashed = mixed(hashed, words[numbers[starts + length - 1]])
        if length >= SHORTEST:
            yield starts, hashed


def count_words(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch, and (lang, shard, n) with all words of a shard."""
    for batch in batches(tables):
        names = batch.words()
        for (lang, shard), numbers in batch.texts():
            counts = np.bincount(numbers)
            counts[BREAK] = 0
            held = np.flatnonzero(counts)
            n = len(held)
            yield pa.record_batch(
                [
                    pa.array([lang] * (n + 1), pa.string()),
                    pa.array([None] * n + [shard], pa.int32()),
                    pa.array([names[k] for k in held] + [None], pa.binary()),
                    pa.array(counts[held].tolist() + [int(counts.sum())], pa.int64()),
                ],
                ["lang", "shard", "word", "n"],
            )


def short_hash(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits, which name a bucket, and the 32 after them."""
    return hashed >> np.uint64(32 - bits)


def mine_batches(bits: int, longest: int) -> Callable:
    """The phrases of each batch by language, shard and bucket, as hashes and counts."""

    def mine(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(tables):
            words = batch.hashes()
            for (lang, shard), numbers in batch.texts():
                found = [h for _, h in phrase_hashes(numbers, words, lang, longest)]
                hashed, counts = np.unique(
                    short_hash(np.concatenate(found), bits), return_counts=True
                )
                bucket = (hashed >> np.uint64(32)).astype(np.int64)
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                low = hashed.astype(np.uint32)
                parts = list(zip(at, [*at[1:], len(bucket)]))
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(parts), pa.string()),
                        pa.array([shard] * len(parts), pa.int32()),
                        pa.array(bucket[at], pa.int64()),
                        pa.array([low[i:j].tobytes() for i, j in parts], pa.binary()),
                        pa.array([packed(counts[i:j]) for i, j in parts], pa.binary()),
                    ],
                    ["lang", "shard", "bucket", "hashes", "counts"],
                )

    return mine


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def unpacked(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(counts) // n}").astype(np.int64)


def frequent_hashes(table: pa.Table) -> pa.Table:
    """The hashes of a bucket of one language and shard that reach its support (column least)."""
    values, counts = [], []
    for low, count in zip(table.column("hashes"), table.column("counts")):
        value = np.frombuffer(low.as_py(), np.uint32)
        values.append(value)
        counts.append(unpacked(count.as_py(), len(value)))
    value, count = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(value, kind="stable")
    value, count = value[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    kept = value[at][np.add.reduceat(count, at) >= table.column("least")[0].as_py()]
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "bucket": pa.array([bucket], pa.int64()),
            "hashes": pa.array([kept.tobytes()], pa.binary()),
            "n": pa.array([len(kept)], pa.int64()),
        }
    )


def places(hashed: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of the bitmap and the two places in it of each short hash."""
    spread = mixed(hashed, _K1)
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    block = (spread >> np.uint64(32)) & np.uint64(blocks - 1)
    first, second = spread & mask, (spread >> np.uint64(BLOCK_BITS)) & mask
    return block.astype(np.int64), first.astype(np.int64), second.astype(np.int64)


def block_maps(blocks: int) -> Callable:
    """(block, bits) of the candidates of each batch of buckets."""

    def build(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            found = []
            for bucket, low in zip(table.column("bucket"), table.column("hashes")):
                value = np.frombuffer(low.as_py(), np.uint32).astype(np.uint64)
                found.append(np.uint64(bucket.as_py()) << np.uint64(32) | value)
            block, first, second = places(np.concatenate(found), blocks)
            order = np.argsort(block, kind="stable")
            block, first, second = block[order], first[order], second[order]
            at = np.flatnonzero(np.diff(block, prepend=-1))
            maps = []
            for i, j in zip(at, [*at[1:], len(block)]):
                bits = np.zeros(1 << BLOCK_BITS, np.uint8)
                bits[first[i:j]] = 1
                bits[second[i:j]] = 1
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.record_batch(
                [pa.array(block[at], pa.int64()), pa.array(maps, pa.binary())], ["block", "bits"]
            )

    return build


def joined_maps(table: pa.Table) -> pa.Table:
    """All bits of one block."""
    maps = [np.frombuffer(m.as_py(), np.uint8) for m in table.column("bits")]
    bits = np.bitwise_or.reduce(maps)
    return pa.table({"block": table.column("block").slice(0, 1), "bits": [bits.tobytes()]})


def bitmap(candidates: DataFrame, total: int) -> tuple[np.ndarray, int]:
    """The bitmap of the candidates (bucket, hashes) and its number of blocks.

    Its size is bounded by ``MOST_BLOCKS``; beyond that more phrases pass by chance.
    """
    asked = max(1, total * BITS_A_PHRASE >> BLOCK_BITS)
    blocks = min(MOST_BLOCKS, 1 << (asked - 1).bit_length())
    maps = candidates.select("bucket", "hashes").mapInArrow(
        block_maps(blocks), "block long, bits binary"
    )
    rows = maps.groupBy("block").applyInArrow(joined_maps, "block long, bits binary").collect()
    bits = np.zeros((blocks, (1 << BLOCK_BITS) // 8), np.uint8)
    for row in rows:
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1), blocks


def holds(bits: np.ndarray, blocks: int, hashed: np.ndarray) -> np.ndarray:
    """Which short hashes may be candidates."""
    block, first, second = places(hashed, blocks)
    start = block << (BLOCK_BITS - 3)
    one = bits[start + (first >> 3)] >> (first & 7).astype(np.uint8)
    two = bits[start + (second >> 3)] >> (second & 7).astype(np.uint8)
    return (one & two & 1).astype(bool)


def count_candidates(shared, blocks: int, bits: int, longest: int) -> Callable:
    """(lang, size, phrase, n) of the phrases of each batch that the bitmap holds.

    Phrases are told apart by their words here, not by hashes.
    """

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches(tables):
            words, names = batch.hashes(), batch.words()
            for (lang, _), numbers in batch.texts():
                size = SHORTEST
                for starts, hashed in phrase_hashes(numbers, words, lang, longest):
                    starts = starts[holds(asked, blocks, short_hash(hashed, bits))]
                    key = numbers[starts]
                    for k in range(1, size):
                        _, key = np.unique(key, return_inverse=True)
                        key = key.astype(np.int64) * len(names) + numbers[starts + k]
                    _, at, n = np.unique(key, return_index=True, return_counts=True)
                    own = numbers[starts[at][:, None] + np.arange(size)]
                    phrases = [b" ".join([names[w] for w in row]) for row in own.tolist()]
                    yield pa.record_batch(
                        [
                            pa.array([lang] * len(n), pa.string()),
                            pa.array([size] * len(n), pa.int32()),
                            pa.array(phrases, pa.binary()),
                            pa.array(n, pa.int64()),
                        ],
                        ["lang", "size", "phrase", "n"],
                    )
                    size += 1

    return count


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    support: int = SUPPORT,
    shards: int = SHARDS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of all phrases of 1 to ``longest`` words that reach the support,
    and ``lang, n``, the words of each language."""
    spark = docs.sparkSession
    ship(spark)
    value = text_of(text)
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(value), F.lit(shards)).cast("int").alias("shard"),
        value.cast("binary").alias("value"),
    ).filter(F.length("value") > 0)
    counted = rows.mapInArrow(count_words, "lang string, shard int, word binary, n long")
    words = written(
        counted.groupBy("lang", "shard", F.col("word").cast("string").alias("word")).agg(
            F.sum("n").alias("n")
        ),
        "words",
    )
    shares = words.filter("word IS NULL AND n > 0").select("lang", "shard", "n")
    totals = written(shares.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, whole * (longest - 1) // BUCKET_PHRASES)
    bits = min(32, (buckets - 1).bit_length())

    share = F.ceil(F.lit(support).cast("decimal(10,0)") * F.col("n") / F.col("total"))
    least = shares.join(totals.withColumnRenamed("n", "total"), "lang").select(
        "lang", "shard", share.cast("long").alias("least")
    )
    mined = rows.mapInArrow(
        mine_batches(bits, longest),
        "lang string, shard int, bucket long, hashes binary, counts binary",
    )
    frequent = (
        lookup(mined, written(least, "least"), ["lang", "shard"], ["bucket"])
        .groupBy("lang", "shard", "bucket")
        .applyInArrow(frequent_hashes, "bucket long, hashes binary, n long")
    )
    candidates = written(frequent.filter("n > 0"), "candidates")
    total = candidates.agg(F.sum("n")).first()[0] or 0
    bitset, blocks = bitmap(candidates, total)
    shared = spark.sparkContext.broadcast(bitset)
    exact = rows.mapInArrow(
        count_candidates(shared, blocks, bits, longest),
        "lang string, size int, phrase binary, n long",
    )
    phrases = exact.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase"))
    single = words.filter("word IS NOT NULL").select(
        "lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), F.col("n").alias("f")
    )
    every = single.unionByName(phrases.agg(F.sum("n").alias("f")))
    return written(every.filter(F.col("f") >= support), "phrases"), totals


def score_of(whole: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact for counts below 10^16."""
    a, l, r = (c.cast("decimal(16,0)") for c in (whole, left, right))
    product = F.lit(1_000_000).cast("decimal(7,0)") * a * a
    return F.call_function("div", product, l * r).cast("long")


def weakest_cut(phrases: DataFrame) -> DataFrame:
    """Phrases of two or more words with l, r and score of the cut that scores lowest."""
    several = phrases.filter(F.col("size") > 1)
    cuts = several.select(
        "lang", "size", "phrase", "f", F.explode(F.expr("sequence(1, size - 1)")).alias("cut")
    ).select(
        "*",
        F.expr("substring_index(phrase, ' ', cut)").alias("left"),
        F.expr("substring_index(phrase, ' ', cut - size)").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        part = phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])
    scored = cuts.withColumn("score", score_of(F.col("f"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("lowest")
    found = scored.groupBy("lang", "size", "phrase", "f").agg(lowest)
    return found.select("lang", "size", "phrase", F.col("f").alias("a"), "lowest.*").drop("cut")


def parts_of(size: Column, phrase: Column) -> Column:
    """All shorter phrases of two or more words inside a phrase."""
    words = F.split(phrase, " ")
    return F.flatten(
        F.transform(
            F.sequence(F.lit(SHORTEST), size - 1),
            lambda length: F.transform(
                F.sequence(F.lit(1), size - length + 1),
                lambda start: F.array_join(F.slice(words, start, length), " "),
            ),
        )
    )


def uncovered(scored: DataFrame, covered: int = COVERED) -> DataFrame:
    """Without the phrases that a longer one covers in so many percent of their occurrences."""
    longer = scored.filter(F.col("size") > SHORTEST).select(
        "lang", F.explode(parts_of(F.col("size"), F.col("phrase"))).alias("phrase"), "a"
    )
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.coalesce(100 * F.col("most"), F.lit(0)) < covered * F.col("a")).drop("most")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    support: int = SUPPORT,
    first: int = FIRST,
    shards: int = SHARDS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    phrases, totals = frequent_phrases(docs, text, lang, longest, support, shards)
    best = uncovered(weakest_cut(phrases))
    ranked = best.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))
    for own in (["lang", "deal"], ["lang"]):
        order = Window.partitionBy(*own).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order))
        ranked = ranked.filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f
      WHERE size > 1 AND f >= 10),
k AS (
  SELECT lang, size, phrase, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c
  UNION ALL
  SELECT lang, size, phrase, a, 2, array_to_string(w[:2], ' '), w[3] FROM c WHERE size = 3),
s AS (
  SELECT k.lang, k.size, k.phrase, a, cut, l.f AS l, r.f AS r,
         (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp
  JOIN f r ON r.lang = k.lang AND r.phrase = rp),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) GROUP BY ALL),
o AS (
  SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase
  WHERE coalesce(100 * i.a, 0) < 50 * m.a),
z AS (SELECT o.lang, row_number() OVER (PARTITION BY o.lang
             ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
      FROM o JOIN n ON n.lang = o.lang)
SELECT * FROM z WHERE rank <= 2000
"""
