"""A convolutional text classifier on hashed word embeddings, trained in numpy.

A word's embedding is the sum of the embeddings of its hashed features: the word itself and its
first and last letters. Filters of several widths run over the words of the whole text, each keeps
its largest response (max pooling), and a logistic layer turns these into a score. A threshold is
calibrated for each language on labelled rows that were not fitted on, and reported beside the score.
Scoring reads the text alone.

Training takes every labelled row. Rows are dealt out to shards by a hash of their id, and their words are
found and hashed once, into a table of batches that every round reads. In each round a task goes through
its shards, each from the common model on, and adds up how far they moved it; the sums of all tasks are
added by blocks of the embeddings, and the common model moves by the mean of its shards, an embedding by
the mean of those that hold it. Only the model, which has a fixed size, passes through the driver.
Thresholds come from the counts of labels by score over all rows kept for them.

In tasks, filters are applied to embeddings once for each distinct word of some texts: a word's row holds its
part of every filter at every place, and a text adds shifted rows and takes their maxima.

Defined cases. A null or empty text is padded like any short one and gets the score of no words.
Ids may be null (never held out) or repeated; each row is scored by itself. Labels that are null,
or of ids without a document, are not used; of a repeated id one text and one label are fitted on. Without any usable label of both classes every score
is the share of toxic labels, or 0. Equal scores are on one side of a threshold. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import copy
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.llm.support import ship, text_of
from verbena.operators.joins import is_small
from verbena.operators.ordering import running, running_sum, value_chunks
from verbena.session import fresh_path, written

BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
MOST_BYTES = 64 << 20  # most bytes of text in each class, where a caller asks for a sample
SHARD = 4_000  # rows of a shard, about
SUMS = 32  # blocks of the embeddings, in which the shards' moves are added up
LONG = 1 << 16  # words of a text that are looked at together
EPOCHS = 5
BATCH = 32
RATE = 0.01
HELD_OUT = 5  # one row in five, by checksum of the id
CALIBRATE = 1  # the remainder of the rows kept for thresholds
STORED = 150_000  # words whose codes a worker keeps
GROUP = 1 << 16  # words of texts that are scored together, about
WHOLE = 1 << 30  # bytes of a row group of batches, at most: more than a task writes of the text it reads

TOKEN = re.compile(r"[^\W\d_]+")


PLAIN = 32  # bytes of a word up to which checksums are taken for all words at once

#: What a byte does to a CRC-32, as zlib's table.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (CRC >> np.uint32(1))


def checksums(data: np.ndarray, first: np.ndarray, last: np.ndarray, mark: bytes) -> np.ndarray:
    """The CRC-32 of the mark and ``data[first:last]``, for each pair of places."""
    sizes = last - first
    order = np.argsort(-sizes, kind="stable")
    falling, at = -sizes[order], first[order]
    known = zlib.crc32(mark)
    crc = np.full(len(order), known ^ 0xFFFFFFFF, np.uint32)
    longer = int(np.searchsorted(falling, -PLAIN))
    for j in range(min(PLAIN, int(sizes.max(initial=0)))):
        some = crc[: np.searchsorted(falling, -j)]  # words of over j bytes
        some[:] = CRC[(some ^ data[at[: len(some)] + j]) & 255] ^ (some >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[:longer]:
        out[i] = zlib.crc32(data[first[i] : last[i]], known)
    return out


def features_of(words: list[str] | pa.Array) -> np.ndarray:
    """Buckets of words' features: the word (w), its first letters (3, 4, 5) and its last ones (e)."""
    array = pa.array(words, pa.large_string()) if isinstance(words, list) else words
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset :][: len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[: bounds[-1] if len(array) else 0]
    begins = (data & 0xC0) != 0x80  # a character begins here
    starts = np.append(np.flatnonzero(begins), len(data))
    places = np.append(0, np.cumsum(begins))[bounds if len(array) else [0]]
    first, last = places[:-1], places[1:]
    parts = [(b"w", first, last)]
    parts += [(b"%d" % k, first, np.minimum(first + k, last)) for k in (3, 4, 5)]
    parts += [(b"e", np.maximum(last - 4, first), last)]
    found = [checksums(data, starts[a], starts[b], mark) % BUCKETS for mark, a, b in parts]
    return np.stack(found, axis=1).astype(np.int64)


def features(word: str) -> list[int]:
    """``features_of`` one word."""
    return features_of([word])[0].tolist()


#: Latin-1 by letter or blank, so that most texts need no regular expression.
LETTERS = bytes(c if TOKEN.match(chr(c)) else 32 for c in range(256))


def words_in(text: str) -> list[str]:
    lower = text.lower()
    try:
        plain = lower.encode("latin-1")
    except UnicodeEncodeError:
        return TOKEN.findall(lower)
    return plain.translate(LETTERS).decode("latin-1").split()


@dataclass
class Model:
    """Embeddings, filters and the logistic layer."""

    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.5  # threshold of a language without labels

    @classmethod
    def new(cls, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        pooled = FILTERS * len(WIDTHS)
        return cls(
            embed=rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
            filters=[rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            bias=np.zeros(pooled, np.float32),
            weight=rng.normal(0, 0.3, pooled).astype(np.float32),
            shift=0.0,
        )

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """For words given by their buckets: each filter's part at each place, side by side."""
        vectors = self.embed[buckets].sum(axis=1)
        return np.hstack([vectors @ f[k] for f in self.filters for k in range(len(f))])

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter over a text, and where it starts."""
        short = max(WIDTHS) - len(rows)
        if short > 0:
            rows = np.vstack([rows, np.zeros((short, rows.shape[1]), rows.dtype)])
        best, where, column = [], [], 0
        for width in WIDTHS:
            n = len(rows) - width + 1
            total = rows[:n, column : column + FILTERS].copy()
            for k in range(1, width):
                at = column + k * FILTERS
                total += rows[k : k + n, at : at + FILTERS]
            place = total.argmax(axis=0)
            best.append(total[place, np.arange(FILTERS)])
            where.append(place)
            column += width * FILTERS
        return np.concatenate(best), np.concatenate(where)

    def pooled_from(self, table: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``pooled`` of the table's rows at these places, of a long text piece by piece."""
        best, where = self.pooled(table[places[: LONG + max(WIDTHS) - 1]])
        for at in range(LONG, len(places) - max(WIDTHS) + 1, LONG):
            more, there = self.pooled(table[places[at : at + LONG + max(WIDTHS) - 1]])
            where = np.where(more > best, there + at, where)
            best = np.maximum(best, more)
        return best, where

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled + self.bias, 0) @ self.weight + self.shift)


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class Words(dict):
    """Codes of words and their buckets, as long as they are few."""

    def __init__(self):
        self.buckets = np.zeros((STORED, 5), np.int64)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        """A new word's code is the number of words known before it."""
        code = self[word] = len(self)
        self.new.append(word)
        return code

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The words of texts by code; codes hold until the next call."""
        if len(self) > STORED:
            self.clear()
        found = map(words_in, texts)
        coded = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in found]
        if len(self) > len(self.buckets):
            self.buckets = np.vstack([self.buckets, np.zeros((len(self), 5), np.int64)])
        self.buckets[len(self) - len(self.new) : len(self)] = features_of(self.new)
        self.new.clear()
        return coded


@dataclass
class Coded:
    """A batch of texts, given by its distinct words."""

    places: np.ndarray  # of the texts' words, one text after the other: their rows in buckets
    sizes: np.ndarray  # words of each text
    buckets: np.ndarray  # of the distinct words
    labels: np.ndarray

    @classmethod
    def of(cls, coded: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray) -> Coded:
        """The batch of texts that are given as codes of words."""
        used, places = np.unique(np.concatenate(coded), return_inverse=True)
        return cls(places, np.array([len(c) for c in coded]), buckets[used], labels)

    def row(self) -> list[bytes]:
        """The batch as ``from_row`` reads it."""
        kinds = kind_of(len(self.buckets)), "<i4", "<u2", "<f8"
        parts = self.places, self.sizes, self.buckets, self.labels
        return [part.astype(kind).tobytes() for part, kind in zip(parts, kinds, strict=True)]

    @classmethod
    def from_row(cls, places: bytes, sizes: bytes, buckets: bytes, labels: bytes) -> Coded:
        of = np.frombuffer(buckets, "<u2").reshape(-1, 5).astype(np.int64)
        at, n = np.frombuffer(places, kind_of(len(of))), np.frombuffer(sizes, "<i4")
        return cls(at.astype(np.int64), n.astype(np.int64), of, np.frombuffer(labels, "<f8"))


def kind_of(rows: int) -> str:
    """The smallest type that numbers so many rows."""
    return "<u2" if rows <= 1 << 16 else "<i4"


class Trainer:
    """A model and the sums of squares that scale its steps."""

    def __init__(self, model: Model):
        self.model = model
        self.moments = [np.zeros_like(p) for p in self.params]
        self.drift = np.zeros_like(model.embed)

    @property
    def params(self) -> list[np.ndarray]:
        return [*self.model.filters, self.model.bias, self.model.weight]

    def step(self, coded: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray, rate: float):
        """Move the model by one batch of texts, given as codes of words."""
        self.step_by(Coded.of(coded, buckets, labels), rate)

    def step_by(self, batch: Coded, rate: float) -> None:
        """Move the model by one batch of texts."""
        model, n = self.model, len(batch.sizes)
        inverse, sizes, labels = batch.places, batch.sizes, batch.labels
        first = np.cumsum(sizes) - sizes
        vectors = model.embed[batch.buckets].sum(axis=1)
        rows = np.hstack([vectors @ f[k] for f in model.filters for k in range(len(f))])
        found = [model.pooled_from(rows, inverse[a : a + k]) for a, k in zip(first, sizes, strict=True)]
        where = np.array([w for _, w in found])
        active = np.maximum(np.array([best for best, _ in found]) + model.bias, 0)
        error = 1 / (1 + np.exp(-np.clip(active @ model.weight + model.shift, -30, 30))) - labels
        back = error[:, None] * model.weight * (active > 0)
        grads = [np.zeros_like(p) for p in self.params]
        grads[-1] += error @ active
        grads[-2] += back.sum(axis=0)
        pull = np.zeros_like(vectors)
        for f, width in enumerate(WIDTHS if len(vectors) else ()):
            cut = slice(f * FILTERS, (f + 1) * FILTERS)
            for k in range(width):
                places = where[:, cut] + k
                real = places < sizes[:, None]  # places behind a short text hold no word
                at_word = inverse[np.where(real, first[:, None] + places, 0)]
                part = (back[:, cut] * real).astype(np.float32)
                grads[f][k] += np.einsum("nfd,nf->df", vectors[at_word], part)
                add_rows(pull, at_word.reshape(-1), (model.filters[f][k].T * part[:, :, None]).reshape(-1, DIM))
        model.shift -= rate * float(error.sum()) / n
        for p, g, m in zip(self.params, grads, self.moments, strict=True):
            g /= n
            m += g * g
            p -= rate * 4 * g / (np.sqrt(m) + 1e-6)
        moved = np.nonzero(np.abs(pull).sum(axis=1))[0]
        spread = batch.buckets[moved]
        flat = spread.reshape(-1)
        step = np.repeat(pull[moved], spread.shape[1], axis=0) / n
        add_rows(self.drift, flat, step * step)
        add_rows(model.embed, flat, -rate * 4 * step / (np.sqrt(self.drift[flat]) + 1e-6))


def add_rows(table: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to the table's rows at the places, which may repeat."""
    flat = (places[:, None] * table.shape[1] + np.arange(table.shape[1])).reshape(-1)
    np.add.at(table.reshape(-1), flat, rows.astype(table.dtype).reshape(-1))


def fit(texts: list[str], labels: np.ndarray, prior: float, seed: int = 1) -> Model:
    """Train on texts with labels 0 and 1; ``prior`` is the share of 1 to expect when scoring."""
    trainer, words, rng = Trainer(Model.new(seed)), Words(), np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            coded = words.codes([texts[i] for i in batch])
            trainer.step(coded, words.buckets, labels[batch], RATE / (1 + epoch))
    expect(trainer.model, float(labels.mean()) if len(labels) else prior, prior)
    return trainer.model


def expect(model: Model, share: float, prior: float) -> None:
    """Shift a model fitted on a ``share`` of label 1 to a share of ``prior``."""
    if 0 < share < 1 and 0 < prior < 1:
        model.shift += np.log(prior / (1 - prior)) - np.log(share / (1 - share))


class Moves:
    """How far shards moved a model and its sums of squares, added up, as rows by block."""

    def __init__(self, start: Trainer):
        self.start = start
        self.embed = np.zeros(start.model.embed.shape, np.float64)
        self.drift = np.zeros(start.model.embed.shape, np.float64)
        self.held = np.zeros(BUCKETS, np.float64)  # shards that moved an embedding
        self.dense = np.zeros_like(flat_of(start))
        self.shards = 0

    def add(self, end: Trainer) -> None:
        added = end.drift - self.start.drift
        self.embed += end.model.embed - self.start.model.embed
        self.drift += added
        self.held += added.any(axis=1)
        self.dense += flat_of(end) - flat_of(self.start)
        self.shards += 1

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """The sums, in blocks of single precision; the block SUMS holds what is not an embedding."""
        size = BUCKETS // SUMS
        for block in range(SUMS):
            cut = slice(block * size, (block + 1) * size)
            parts = (self.embed[cut], self.drift[cut], self.held[cut])
            yield block, np.concatenate([p.reshape(-1) for p in parts]).astype(np.float32).tobytes()
        yield SUMS, np.append(self.dense, self.shards).astype(np.float32).tobytes()


def flat_of(trainer: Trainer) -> np.ndarray:
    """What a trainer holds beside the embeddings, as one vector."""
    parts = [*trainer.params, *trainer.moments, np.array([trainer.model.shift])]
    return np.concatenate([p.reshape(-1) for p in parts]).astype(np.float64)


def move(trainer: Trainer, sums: dict[int, np.ndarray]) -> None:
    """Move a trainer by the means of what ``Moves.rows`` say, added up over all tasks."""
    size = BUCKETS // SUMS
    for block in range(SUMS):
        cut = slice(block * size, (block + 1) * size)
        embed, drift, held = np.split(sums[block], [size * DIM, 2 * size * DIM])
        mean = np.maximum(held, 1)[:, None]
        trainer.model.embed[cut] += (embed.reshape(size, DIM) / mean).astype(np.float32)
        trainer.drift[cut] += (drift.reshape(size, DIM) / mean).astype(np.float32)
    dense, at = sums[SUMS][:-1] / max(1, sums[SUMS][-1]), 0
    for p in [*trainer.params, *trainer.moments]:
        p += dense[at : at + p.size].reshape(p.shape).astype(p.dtype)
        at += p.size
    trainer.model.shift += float(dense[at])


def coded_rows(rows: Iterator[tuple[int, str, int]]) -> Iterator[tuple[int, Coded]]:
    """Batches of rows (shard, text, label), in order of the shard, each with its shard."""
    words = Words()
    for shard, own in groupby(rows, lambda r: r[0]):
        for batch in batched(own, BATCH):
            coded = words.codes([text for _, text, _ in batch])
            yield shard, Coded.of(coded, words.buckets, np.array([y for *_, y in batch], float))


def coded_moves(start: Trainer, rate: float, batches: Iterator[tuple[int, Coded]]) -> Moves:
    """What one round of steps over batches, in order of the shard, moves."""
    moves = Moves(start)
    for _, own in groupby(batches, lambda r: r[0]):
        end = copy.deepcopy(start)
        for _, batch in own:
            end.step_by(batch, rate)
        moves.add(end)
    return moves


def shard_moves(start: Trainer, rate: float, rows: Iterator[tuple[int, str, int]]) -> Moves:
    """What one round of steps over ``rows`` (shard, text, label), in order of the shard, moves."""
    return coded_moves(start, rate, coded_rows(rows))


def coded_table(rows: DataFrame) -> DataFrame:
    """``shard, places, sizes, buckets, labels``: the batches of a table as ``fit_shards`` reads it, once for all rounds."""
    ship(rows.sparkSession)
    types = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in BATCHES[1:]]])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, batch in coded_rows(tuples(batches)):
            yield pa.RecordBatch.from_pylist([dict(zip(BATCHES, [shard, *batch.row()], strict=True))], schema=types)

    schema = "shard int, places binary, sizes binary, buckets binary, labels binary"
    coded = rows.select("shard", "text", "toxic").mapInArrow(code, schema)
    path = fresh_path(rows.sparkSession, "coded")
    # One row group a file, so that reading splits no shard in two.
    coded.write.option("parquet.block.size", WHOLE).parquet(path)
    return rows.sparkSession.read.schema(coded.schema).parquet(path)


def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of record batches."""
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(c[k].as_py() for c in b.columns)


def fit_shards(rows: DataFrame, share: float, seed: int = 1) -> Model:
    """Train on a written table ``shard, text, toxic``, whose files are in order of the shard."""
    spark = rows.sparkSession
    ship(spark)
    trainer = Trainer(Model.new(seed))
    trainer.model.shift = float(np.log(share / (1 - share)))
    # A task adds its shards up itself, so what is sent grows with the cores, not with the rows.
    tasks = coded_table(rows).coalesce(spark.sparkContext.defaultParallelism)
    schema = "block int, sums binary"

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table["sums"])
        return pa.table({"block": [key[0].as_py()], "sums": [total.tobytes()]}, schema=SUM_TYPES)

    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(pickle.dumps(trainer))  # of a fixed size
        rate = RATE / (1 + epoch)

        def round_of(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            each = ((shard, Coded.from_row(*parts)) for shard, *parts in tuples(batches))
            moves = coded_moves(pickle.loads(shared.value), rate, each)
            if moves.shards:
                blocks, sums = zip(*moves.rows(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(sums, pa.binary())], schema=SUM_TYPES)

        parts = tasks.select(*BATCHES).mapInArrow(round_of, schema)
        sums = parts.groupBy("block").applyInArrow(added, schema).collect()
        move(trainer, {r["block"]: np.frombuffer(r["sums"], np.float64) for r in sums})
        shared.destroy()
    return trainer.model


class Scorer:
    """Scores texts by a model, some at a time: each of their distinct words is looked at once."""

    def __init__(self, model: Model):
        self.model = model

    def scores(self, texts: Iterable[str]) -> Iterator[float]:
        words: list[str] = []
        sizes: list[int] = []
        for text in texts:
            found = words_in(text)
            words += found
            sizes.append(len(found))
            if len(words) >= GROUP or len(sizes) >= GROUP:
                yield from self.scores_of(words, sizes)
                words, sizes = [], []
        yield from self.scores_of(words, sizes)

    def scores_of(self, words: list[str], sizes: list[int]) -> Iterator[float]:
        """The scores of texts of so many words each."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        table, places, at = self.model.rows(features_of(coded.dictionary)), coded.indices.to_numpy(), 0
        for n in sizes:
            yield logistic(self.model.logit(self.model.pooled_from(table, places[at : at + n])[0]))
            at += n

    def score(self, text: str) -> float:
        return next(self.scores([text]))


SUM_TYPES = pa.schema([("block", pa.int32()), ("sums", pa.binary())])
BATCHES = ["shard", "places", "sizes", "buckets", "labels"]


_scorers: dict[int, Scorer] = {}


def scorer_of(model: bytes) -> Scorer:
    """The worker's scorer of a model; one is kept."""
    mark = zlib.crc32(model)
    if mark not in _scorers:
        _scorers.clear()
        _scorers[mark] = Scorer(pickle.loads(model))
    return _scorers[mark]


def remainder(key: Column) -> Column:
    """The checksum of the id's digits, modulo five; null ids have none."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(HELD_OUT))


def best_thresholds(scored: DataFrame) -> DataFrame:
    """``lang, threshold``: the threshold of the best F1 of each language, and of all where lang is null.

    ``scored`` (lang, toxic, score) has no null language. A threshold lies half way between two scores;
    of equally good ones the highest is taken. Languages without a toxic row have none.
    """
    either = F.explode(F.array(F.lit(None).cast("string"), F.col("lang"))).alias("lang")
    counts = scored.select(either, "toxic", (-F.col("score")).alias("falling")).groupBy("lang", "falling")
    counts = counts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    cut = value_chunks(counts, ["lang"], ["falling"])
    sums = {"seen": running_sum(F.col("n")), "hits": running_sum(F.col("toxic"))}
    so_far = written(running(cut, ["lang"], "_chunk", ["falling"], sums), "hits")
    every = so_far.groupBy("lang").agg(F.sum("toxic").alias("every")).filter("every > 0")
    at = so_far.join(F.broadcast(every.withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of")))
    f1 = 2 * F.col("hits") / (F.col("seen") + F.col("every"))
    best = at.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), (-F.col("falling")).alias("score"))).alias("best"))
    best = written(best.select(F.col("lang").alias("of"), "best.score"), "best")
    lower = so_far.join(F.broadcast(best), F.col("lang").eqNullSafe(F.col("of")) & (-F.col("falling") < F.col("score")))
    below = lower.groupBy("of").agg(F.max(-F.col("falling")).alias("below")).withColumnRenamed("of", "lang")
    found = best.join(F.broadcast(below), F.col("of").eqNullSafe(F.col("lang")), "left")
    return found.select(F.col("of").alias("lang"), ((F.col("score") + F.coalesce("below", F.lit(0.0))) / 2).alias("threshold"))


def labelled(docs: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """``toxic, held, doc_id, lang, text, shard``: every row to fit on (held false) or to calibrate with.

    An id with several labels is toxic if one says so; of several documents with an id the shortest is
    taken, of equally long ones the first. The files of the table are in order of the shard.
    """
    hashed = F.xxhash64("doc_id", F.lit("shard"))
    held = remainder(F.col("doc_id")) == CALIBRATE
    ids = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(
        "doc_id", "toxic", held.alias("held"), hashed.alias("hashed")
    )
    ids = written(ids, "ids")
    shard = F.when(F.col("held"), -1).otherwise(F.pmod("hashed", F.lit(shards))).cast("int")
    # Rows to calibrate with have no order; they are dealt out like the others.
    spot = F.when(F.col("held"), F.col("hashed"))
    found = texts_of(docs).join(F.broadcast(ids) if is_small(ids) else ids.hint("merge"), "doc_id")
    # All rows of an id are in one partition of these.
    dealt = found.withColumn("shard", shard).withColumn("spot", spot).repartition("shard", "spot")
    own = F.struct(F.octet_length("text").alias("bytes"), "text", "lang")
    once = dealt.groupBy("shard", "spot", "hashed", "doc_id", "toxic", "held").agg(F.min(own).alias("own"))
    rows = once.sortWithinPartitions("shard", "spot", "hashed", "doc_id")
    return written(rows.select("toxic", "held", "doc_id", "own.lang", "own.text", "shard"), "labelled")


def texts_of(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select("doc_id", text_of().alias("text"), lang.alias("lang"))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, most_bytes: int) -> DataFrame:
    """A bounded part of ``labelled``, for callers who ask for one.

    Of each of these four groups at most ``sample`` ids, the first by a hash of the id, and of their texts at most
    ``most_bytes``, in the same order; texts of over a sixteenth of that take no part. An id with several labels is toxic if one says so; of several
    documents with an id the shortest is taken, of equally long ones the first.
    """
    hashed = F.xxhash64("doc_id", F.lit("sample"))
    ids = (
        labels.groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("held", remainder(F.col("doc_id")) == CALIBRATE)
    )
    first = [
        ids.filter((F.col("toxic") == toxic) & (F.col("held") == held)).orderBy(hashed, "doc_id").limit(sample)
        for toxic in (0, 1)
        for held in (False, True)
    ]
    few = written(first[0].union(first[1]).union(first[2]).union(first[3]), "sampled")
    own = F.struct(F.octet_length("text").alias("bytes"), "text", "lang")
    # At most four samples of ids are broadcast, so the documents are read once and not moved.
    found = (
        texts_of(docs).join(F.broadcast(few), "doc_id")
        .groupBy("toxic", "held", "doc_id")
        .agg(F.min(own).alias("own"))
        .select("toxic", "held", "doc_id", "own.*")
        .filter(F.col("bytes") <= most_bytes // 16)
    )
    so_far = Window.partitionBy("toxic", "held").orderBy(hashed, "doc_id")
    return (
        written(found, "sample").withColumn("upto", F.sum("bytes").over(so_far))
        .filter(F.col("upto") <= most_bytes)
        .select("toxic", "held", "doc_id", "lang", "text")
    )


def train(
    docs: DataFrame, labels: DataFrame, sample: int | None = None, most_bytes: int = MOST_BYTES
) -> Model:
    """Fit on every labelled row outside the held-out fifth, but calibrate with another fifth of them.

    With ``sample`` both take at most so many rows of each class, by a hash of their id, and at most
    ``most_bytes`` of their texts.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0)
    )
    prior = usable.agg(F.avg("toxic")).first()[0] or 0.0
    if sample is not None:
        few = written(sampled(docs, usable, sample, most_bytes), "few")
        docs, usable = few, few.select("doc_id", "toxic")
    ids = usable.agg(F.count_distinct("doc_id")).first()[0]
    dealt = labelled(docs, usable, -(-ids // SHARD) or 1)
    fitted, held = dealt.filter("not held"), dealt.filter("held")
    count = fitted.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not 0 < (count["toxic"] or 0) < count["n"]:
        model = Model.new()
        model.weight[:] = 0
        model.shift = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 60 * prior - 30
        return model
    share = count["toxic"] / count["n"]
    model = fit_shards(fitted, share)
    expect(model, share, prior)
    scored = written(held.select("lang", "toxic", scores(model, held)(F.col("text")).alias("score")), "scored")
    for r in best_thresholds(scored).collect():  # one for each language
        if r["lang"] is None:
            model.common = r["threshold"]
        else:
            model.thresholds[r["lang"]] = r["threshold"]
    return model


def scores(model: Model, rows: DataFrame):
    """A function that scores a column of texts in the tasks of ``rows``."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # of a fixed size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scorer = scorer_of(shared.value)
        return pa.array(scorer.scores(x.as_py() for x in texts), pa.float64())

    return score


def score_toxicity(
    docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, flagged`` of every document.

    ``predicted`` cuts the score at one half, ``flagged`` at the threshold of the language.
    """
    score = scores(model, docs)
    limits = [x for lang, t in sorted(model.thresholds.items()) for x in (F.lit(lang), F.lit(t))]
    threshold = F.lit(model.common)
    if limits and "lang" in docs.columns:
        lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
        threshold = F.coalesce(F.try_element_at(F.create_map(*limits), lang), threshold)
    scored = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(remainder(F.col(key)) == 0, F.lit(False)).alias("held_out"),
        score(text_of(text)).alias("score"),
        threshold.alias("threshold"),
    )
    return scored.select(
        "doc_id",
        "held_out",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        (F.col("score") >= F.col("threshold")).alias("flagged"),
    )
