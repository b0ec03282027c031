"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes of a text marks about one place in 2,048 as a chunk border,
so texts that share a passage share the chunks inside it wherever it stands. Documents are brought
together by their least chunk digest: copies and near copies agree on it with the share of chunks
they have in common. Each task encodes a chunk once and reuses its ids for every document that
holds it. Chunks are then joined: the text around a border is encoded again, with more and more
units on both sides, until the outermost unit on either side comes out as it did in its chunk.

Documents are moved by a rebalancing exchange, so a group of copies of any size is split over
tasks (each of which then encodes its chunks once).

Defined cases. A null text is the empty text: no ids, and an empty decoded text. Ids may be null
or repeated; each row is encoded by itself. A long text is as many chunks as it needs. An empty
table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.llm.support import ship, text_of
from verbena.llm.units import UNIT, Units, units_of

BORDER_BITS = 11  # a border at one byte in 2**11
WINDOW_STEPS = (1, 2, 4, 8)  # doubling gives a window of 16 bytes
STORED_BYTES = 3_000_000  # text of the chunks that a worker keeps
STORED_UNITS = 60_000  # units in each half of its store of units

GEAR = np.random.default_rng(7).integers(0, 2**32, 256, np.uint32)

Chunk = tuple[list[str], list[bytes]]  # units and their ids


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 text: where the rolling hash says so and a character ends."""
    codes = np.frombuffer(data, np.uint8)
    rolling = GEAR[codes]
    for step in WINDOW_STEPS:
        moved = rolling.copy()
        moved[step:] += rolling[:-step] << np.uint32(step)
        rolling = moved
    marked = np.nonzero(rolling >> np.uint32(32 - BORDER_BITS) == 0)[0] + 1
    marked = marked[marked < len(data)]
    whole = (codes[marked] & 0xC0) != 0x80  # the next byte begins a character
    return [*marked[whole].tolist(), len(data)]


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in borders(data) if data else []:
        out.append(data[start:end])
        start = end
    return out


def sketch(text: Column) -> Column:
    """The least digest of a text's chunks."""

    @F.arrow_udf("bigint")
    def least(texts: pa.Array) -> pa.Array:
        import xxhash

        digests = (
            min(map(xxhash.xxh64_intdigest, chunks(x.as_py())), default=0) >> 1 for x in texts
        )
        return pa.array(digests, pa.int64())

    return least(text.cast("binary"))


class ChunkStore:
    """Encoded chunks of a worker; starts anew when it holds ``STORED_BYTES`` of text."""

    def __init__(self, units: Units):
        self.units = units
        self.known: dict[bytes, Chunk] = {}
        self.size = 0

    def encoded(self, chunk: bytes) -> Chunk:
        found = self.known.get(chunk)
        if found is None:
            units = list(map(sys.intern, UNIT.findall(chunk.decode())))
            found = units, self.units.of_units(units)
            if self.size > STORED_BYTES:
                self.known.clear()
                self.size = 0
            self.known[chunk] = found
            self.size += len(chunk)
        return found

    def ids(self, data: bytes) -> bytes:
        """The ids of a whole text from its chunks, repaired at the joins."""
        units: list[str] = []
        ids: list[bytes] = []
        for chunk in chunks(data):
            self.join(units, ids, *self.encoded(chunk))
        return b"".join(ids)

    def join(self, units: list[str], ids: list[bytes], more: list[str], more_ids: list[bytes]):
        """Put ``more`` after ``units``; both lists of the text so far are changed."""
        width = 2
        while units:
            a, b = min(width, len(units)), min(width, len(more))
            again = UNIT.findall("".join(units[-a:]) + "".join(more[:b]))
            again_ids = self.units.of_units(again)
            left = a == len(units) or (again[0] == units[-a] and again_ids[0] == ids[-a])
            right = b == len(more) or (again[-1] == more[b - 1] and again_ids[-1] == more_ids[b - 1])
            if left and right and len(again) > 1 or (a == len(units) and b == len(more)):
                units[-a:], ids[-a:] = again, again_ids
                more, more_ids = more[b:], more_ids[b:]
                break
            width *= 2
        units += more
        ids += more_ids


_stores: dict[str, ChunkStore] = {}


def store_of(path: str) -> ChunkStore:
    if path not in _stores:
        _stores[path] = ChunkStore(units_of(path, STORED_UNITS))
    return _stores[path]


def decoder(units: Units):
    """Text of ids, with special tokens, as the tokenizer's own decode gives it."""
    tokenizer = units.tokenizer
    if tokenizer.decoder is None:  # then a text is its tokens, joined by spaces
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [tokenizer.id_to_token(i) for i in range(size)]
        return lambda ids: " ".join(map(tokens.__getitem__, ids))
    return lambda ids: tokenizer.decode(ids, skip_special_tokens=False)


OUTPUTS = {
    "ids": pa.list_(pa.int32()),
    "decoded": pa.string(),
    "n_tokens": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}


def encode_documents(
    docs: DataFrame,
    tokenizer: str,
    outputs: list[str],
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``doc_id`` and, as ``outputs`` asks: ids, decoded, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)
    kinds = {"ids": "array<int>", "n_tokens": "bigint"}
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{c} {kinds.get(c, 'string')}" for c in outputs]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(tokenizer)
        decode = decoder(store.units)
        names = [str(i) for i in range(store.units.tokenizer.get_vocab_size())]
        for batch in batches:
            out: dict[str, list] = {c: [] for c in outputs}
            for value in batch.column(1):
                ids = np.frombuffer(store.ids(value.as_py()), "<u4").tolist()
                one: dict = {"ids": ids, "n_tokens": len(ids)}
                if "ids_sha256" in out:
                    joined = " ".join(map(names.__getitem__, ids))
                    one["ids_sha256"] = hashlib.sha256(joined.encode()).hexdigest()
                if "decoded" in out or "decoded_sha256" in out:
                    one["decoded"] = decode(ids)
                    one["decoded_sha256"] = hashlib.sha256(one["decoded"].encode()).hexdigest()
                for c in outputs:
                    out[c].append(one[c])
            columns = [batch.column(0), *[pa.array(out[c], OUTPUTS[c]) for c in outputs]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *outputs])

    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    together = rows.withColumn("sketch", sketch(F.col("text"))).hint("rebalance", "sketch")
    return together.select("doc_id", F.col("text").cast("binary")).mapInArrow(encode, schema)
