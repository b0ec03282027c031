"""Repeated passages by sparse suffix arrays.

A text's words are hashed, and of every 25 windows of 26 words in a row the one with the least hash
is an anchor, so every run of 50 words holds an anchor that the run's content selects. Only the
suffixes at anchors are kept, each with its 24 words to the left and to the right. Spark sorts them;
suffixes with the same 26 words stand together. There they are compared with their neighbours for
every way to share 50 words (so many to the left of the anchor, the rest to the right), which tells
how far matches reach to the left and right. Overlapping matches of a text are merged.

An occurrence is first if no equal run of words stands in a document with a smaller id, or further
ahead in the same one. All others may be cut, and every passage stays in one place.

Windows of 26 words that a large share of all documents hold are found in a sample of documents;
their suffixes are not brought together but counted run by run with partial sums, so no task gets
all of them. The result is the same on either way. Exact copies inside a task are sent once.

Words left and right of an anchor are compared by 16 bits of their hash, the anchor by 64 bits.

Defined cases. Words are runs other than ASCII white space and compare exactly. A null text is the
empty text; texts under 50 words have no repeated passage. Rows with the same id and text are one
document. A null id is larger than any other. An empty table gives no spans. Further columns are
not looked at; :func:`cut_repeats` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.llm.nn_descent import runs
from verbena.llm.support import ship, spare, text_of
from verbena.session import written

LEAST = 50  # words of a repeated passage
GRAM = 26  # words of an anchor
SIDE = LEAST - GRAM  # words kept to the left and right
SAMPLE = 16  # one document in so many is looked at for frequent anchors
HOT = 500  # occurrences in the sample that make an anchor frequent
MOST_HOT = 10_000  # frequent anchors that are treated apart
TOGETHER = 100_000  # suffixes compared at a time, more only if one anchor has more
NO_ID = 2**63 - 1

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASE = 0x9E3779B97F4A7C15  # odd
BASE_INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, spread."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, their hashes, and the 16-bit codes of all words.

    Codes have ``SIDE`` zeros before and after, which stand for no word.
    """
    import xxhash

    words = data.split()
    n = len(words)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, n), out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(BASE_INVERSE, n - GRAM + 1))
    windows = np.lib.stride_tricks.sliding_window_view(grams, SIDE + 1)
    positions = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    codes = np.zeros(n + 2 * SIDE, np.uint16)
    codes[SIDE:-SIDE] = np.maximum(hashes >> np.uint64(48), np.uint64(1))
    return positions, grams[positions], codes


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column from a matrix, a row each."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    ends = np.arange(0, (len(data) + 1) * width, width or 1, np.int32)[: len(data) + 1]
    return pa.Array.from_buffers(
        pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())]
    )


SUFFIXES = "gram bigint, doc bigint, digest bigint, pos int, n_words int, left binary, right binary"


def suffixes(texts: DataFrame, hot: np.ndarray, frequent: bool) -> DataFrame:
    """The suffixes at anchors that are (or are not) in ``hot``; copies have no gram.

    A copy of a text that the task has met before under a smaller id gives one row without a gram;
    its ``pos`` is that id.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        met: dict[int, tuple[int, int]] = {}
        for batch in batches:
            grams, docs, digests, places, lengths = [], [], [], [], []
            lefts, rights = [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py()
                digest = xxhash.xxh64_intdigest(data, 1) >> 1
                # A copy with a smaller id than the one met before is sent, as it may be first.
                if digest in met and met[digest][0] <= doc:
                    if not frequent:
                        first, n = met[digest]
                        if n >= LEAST and first != doc:
                            grams.append(None), docs.append(doc), digests.append(digest)
                            places.append(first), lengths.append(n)
                    continue
                positions, found, codes = anchors(data)
                met[digest] = doc, max(0, len(codes) - 2 * SIDE)
                if len(hot) and len(found):
                    own = np.isin(found.view(np.int64), hot) == frequent
                    positions, found = positions[own], found[own]
                elif frequent:
                    positions, found = positions[:0], found[:0]
                if len(found):
                    # Codes start SIDE places early: word p is at p + SIDE.
                    lefts.append(codes[positions[:, None] + np.arange(SIDE - 1, -1, -1)])
                    rights.append(codes[positions[:, None] + SIDE + GRAM + np.arange(SIDE)])
                    grams.extend(found.view(np.int64).tolist())
                    docs.extend([doc] * len(found))
                    digests.extend([digest] * len(found))
                    places.extend(positions.tolist())
                    lengths.extend([0] * len(found))
            if docs:
                plain = [g is not None for g in grams]
                order = np.argsort(~np.array(plain), kind="stable")
                pick = lambda x, kind: pa.array([x[i] for i in order], kind)
                none = np.zeros((len(docs) - sum(plain), SIDE), np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pick(grams, pa.int64()),
                        pick(docs, pa.int64()),
                        pick(digests, pa.int64()),
                        pick(places, pa.int64()),
                        pick(lengths, pa.int32()),
                        fixed_binary(np.vstack([*lefts, none])),
                        fixed_binary(np.vstack([*rights, none])),
                    ],
                    ["gram", "doc", "digest", "pos", "n_words", "left", "right"],
                )

    return texts.mapInArrow(scan, SUFFIXES.replace("pos int", "pos bigint"))


def run_keys(gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A key for each run of 50 words around each anchor; 0 if a text has no such run.

    Column j is the run with j words to the right of the anchor.
    """
    n = len(gram)

    def hashed(start: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, whole = np.zeros((n, SIDE + 1), np.uint64), np.ones((n, SIDE + 1), bool)
        out[:, 0] = start
        for i in range(SIDE):
            out[:, i + 1] = mixed(out[:, i] * np.uint64(31) + codes[:, i].astype(np.uint64))
            whole[:, i + 1] = whole[:, i] & (codes[:, i] > 0)
        return out, whole

    before, b = hashed(gram.view(np.uint64), left)
    after, a = hashed(np.full(n, 7, np.uint64), right)
    keys = mixed(before[:, ::-1] * np.uint64(BASE) + after) | np.uint64(1)
    return np.where(b[:, ::-1] & a, keys, np.uint64(0))


SPANS = "doc bigint, digest bigint, start int, end int, cut_start int, cut_end int"


def span_batch(doc, digest, pos, found: np.ndarray, later: np.ndarray) -> pa.RecordBatch | None:
    """Spans of the anchors for which a run was found; ``later`` marks runs that are not first."""
    some = found.any(axis=1)
    if not some.any():
        return None
    found, later = found[some], later[some]
    doc, digest, pos = doc[some], digest[some], pos[some].astype(np.int64)

    def reach(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = runs.argmax(axis=1), SIDE - runs[:, ::-1].argmax(axis=1)
        none = ~runs.any(axis=1)
        return np.where(none, 0, pos - SIDE + first), np.where(none, 0, pos + GRAM + last)

    arrays = [doc, digest, *reach(found), *reach(later)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)],
        ["doc", "digest", "start", "end", "cut_start", "cut_end"],
    )


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of sorted suffixes (by gram, doc, digest, pos) that share a run with a neighbour."""
    held: list[pa.Table] = []
    size = 0

    def spans() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held).combine_chunks()
        place = np.stack([table.column(c).to_numpy() for c in ("gram", "doc", "digest", "pos")])
        once = np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0))  # repeated rows
        table = table.filter(pa.array(once)).combine_chunks()
        gram = table.column("gram").to_numpy()
        same = np.zeros(len(gram) + 1, bool)
        same[1:-1] = gram[1:] == gram[:-1]
        twice = np.flatnonzero(same[1:] | same[:-1])
        if not len(twice):
            return
        table = table.take(pa.array(twice)).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        side = lambda c: np.frombuffer(
            b"".join(table.column(c).to_pylist()), np.uint16
        ).reshape(len(twice), SIDE)
        keys = run_keys(gram[twice], side("left"), side("right"))
        flat = keys.reshape(-1)
        order = np.argsort(flat, kind="stable")  # rows keep their order by document and place
        ranked = flat[order]
        equal = np.zeros(len(ranked) + 1, bool)
        equal[1:-1] = (ranked[1:] == ranked[:-1]) & (ranked[1:] != 0)
        found, later = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        found[order] = equal[1:] | equal[:-1]
        later[order] = equal[:-1]
        shape = keys.shape
        batch = span_batch(
            column("doc"), column("digest"), column("pos"), found.reshape(shape), later.reshape(shape)
        )
        if batch is not None:
            yield batch

    for table, _ in runs(batches):
        held.append(table)
        size += len(table)
        if size >= TOGETHER:
            yield from spans()
            held, size = [], 0
    if held:
        yield from spans()


def frequent_grams(texts: DataFrame) -> np.ndarray:
    """Anchors that many documents of a sample hold: a bounded list that steers work only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(anchors(x.as_py())[1]) for x in batch.column(1)]
            every = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.int64())], ["gram"])

    sample = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(count, "gram bigint").groupBy("gram").count()
    top = counts.filter(F.col("count") >= HOT).orderBy(F.desc("count"), "gram").limit(MOST_HOT)
    return np.array([r["gram"] for r in top.collect()], np.int64)


def frequent_spans(rows: DataFrame) -> DataFrame:
    """Spans of suffixes with frequent grams: runs are counted, not brought together."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = lambda c: np.frombuffer(  # noqa: E731, B023
                b"".join(batch.column(c).to_pylist()), np.uint16  # noqa: B023
            ).reshape(-1, SIDE)
            keys = run_keys(batch.column("gram").to_numpy(), side("left"), side("right"))
            row, j = np.nonzero(keys)
            take = lambda c: batch.column(c).take(pa.array(row))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[row, j].view(np.int64), pa.int64()),
                    pa.array(j, pa.int32()),
                    take("doc"),
                    take("digest"),
                    take("pos"),
                ],
                ["key", "j", "doc", "digest", "pos"],
            )

    exploded = written(
        rows.mapInArrow(
            explode, "key bigint, j int, doc bigint, digest bigint, pos bigint"
        ).distinct(),
        "runs",
    )
    place = F.struct("doc", "digest", "pos")
    repeated = (
        exploded.groupBy("key")
        .agg(F.min(place).alias("least"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    marked = exploded.join(repeated, "key").withColumn("later", place != F.col("least"))
    start, end = F.col("pos") - SIDE + F.col("j"), F.col("pos") + GRAM + F.col("j")
    cut = F.col("later")
    return marked.groupBy("doc", "digest", "pos").agg(
        F.min(start).cast("int").alias("start"),
        F.max(end).cast("int").alias("end"),
        F.coalesce(F.min(F.when(cut, start)), F.lit(0)).cast("int").alias("cut_start"),
        F.coalesce(F.max(F.when(cut, end)), F.lit(0)).cast("int").alias("cut_end"),
    ).drop("pos")


MERGED = "doc bigint, digest bigint, start int, end int, cuts array<struct<start:int,end:int>>"


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal spans of each document, and what may be cut of them, from spans sorted by start."""
    out: list[dict] = []
    for table, starts in runs(batches):
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["doc"], r["digest"], r["start"], r["end"]))
        for r in rows:
            last = out[-1] if out else None
            same = last and (last["doc"], last["digest"]) == (r["doc"], r["digest"])
            if same and r["start"] <= last["end"]:
                last["end"] = max(last["end"], r["end"])
            else:
                last = {"doc": r["doc"], "digest": r["digest"], "start": r["start"], "end": r["end"], "cuts": []}
                out.append(last)
            if r["cut_end"]:
                last["cuts"].append((r["cut_start"], r["cut_end"]))
        for r in out:
            cuts: list[dict] = []
            for start, end in sorted(r["cuts"]):
                if cuts and start <= cuts[-1]["end"]:
                    cuts[-1]["end"] = max(cuts[-1]["end"], end)
                else:
                    cuts.append({"start": start, "end": end})
            r["cuts"] = cuts
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["doc"] for r in out], pa.int64()),
                    pa.array([r["digest"] for r in out], pa.int64()),
                    pa.array([r["start"] for r in out], pa.int32()),
                    pa.array([r["end"] for r in out], pa.int32()),
                    pa.array([r["cuts"] for r in out], kind),
                ],
                ["doc", "digest", "start", "end", "cuts"],
            )
        out = []


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, digest, start, end, cuts``: repeated passages in words, and what may be cut.

    ``digest`` tells texts of the same id apart.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"),
        text_of(text).cast("binary").alias("text"),
    )
    hot = frequent_grams(texts)
    rows = suffixes(texts, hot, frequent=False)
    ordered = rows.repartition("gram", F.when(F.col("gram").isNull(), F.col("doc")))
    spans = ordered.sortWithinPartitions("gram", "doc", "digest", "pos").mapInArrow(
        compare_and_copies, SPANS
    )
    if len(hot):
        spans = spans.unionByName(frequent_spans(suffixes(texts, hot, frequent=True)))
    merged = (
        spans.repartition("doc")
        .sortWithinPartitions("doc", "digest", "start", "end")
        .mapInArrow(merge, MERGED)
    )
    own = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return merged.select(own.alias(key), "digest", "start", "end", "cuts")


def compare_and_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of sorted suffixes; a copy is a repeated passage from end to end.

    It may be cut; the text it equals, which has a smaller id, may not on its account.
    """

    def sorted_out() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0)
            if grams.null_count:
                copies = batch.filter(grams.is_null())
                rows = []
                for r in copies.select(["doc", "digest", "pos", "n_words"]).to_pylist():
                    rows.append((r["pos"], r["digest"], 0, r["n_words"], 0, 0))
                    rows.append((r["doc"], r["digest"], 0, r["n_words"], 0, r["n_words"]))
                found.append(rows)
                batch = batch.filter(grams.is_valid())
            if len(batch):
                yield batch

    found: list[list[tuple]] = []
    for out in compare(sorted_out()):
        yield out
        while found:
            yield copied(found.pop())
    while found:
        yield copied(found.pop())


def copied(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["doc", "digest", "start", "end", "cut_start", "cut_end"],
    )


def without(text: Column, cuts: Column) -> Column:
    """Texts without the words of their cuts (sorted, apart; null: none)."""

    @F.arrow_udf("string")
    def left(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for value, spans in zip(texts, cuts, strict=True):
            data = value.as_py()
            if spans.is_valid and len(spans):
                starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
                kept, at = [], 0
                for s in spans.as_py():
                    kept.append(data[at : starts[s["start"]]])
                    at = starts[s["end"]]
                data = b"".join([*kept, data[at:]]).rstrip(b"\t\n\x0b\x0c\r ")
            out.append(data.decode())
        return pa.array(out, pa.string())

    return left(text.cast("binary"), cuts)


def text_digest(text: Column) -> Column:
    """The digest that tells texts of an id apart."""

    @F.arrow_udf("bigint")
    def digest(texts: pa.Array) -> pa.Array:
        import xxhash

        return pa.array([xxhash.xxh64_intdigest(x.as_py(), 1) >> 1 for x in texts], pa.int64())

    return digest(text.cast("binary"))


def cut_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents without the repeats that are not first, in the columns they came with.

    A text that is a repeat from end to end becomes the empty text.
    """
    cuts = (
        repeated_spans(docs, text, key)
        .select(key, "digest", F.explode("cuts").alias("cut"))
        .groupBy(key, "digest")
        .agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
        .select(F.col(key).alias("cut_id"), F.col("digest").alias("cut_digest"), "cuts")
    )
    mark, found = spare(docs, "digest"), spare(docs, "cuts")
    rows = docs.withColumn(mark, text_digest(text_of(text)))
    cuts = cuts.withColumnRenamed("cuts", found)
    same = rows[key].eqNullSafe(cuts["cut_id"]) & (rows[mark] == cuts["cut_digest"])
    joined = rows.join(cuts, same, "left").drop("cut_id", "cut_digest")
    done = joined.withColumn(
        text, F.when(F.col(found).isNull(), F.col(text)).otherwise(without(text_of(text), F.col(found)))
    )
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
