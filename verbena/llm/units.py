"""Token ids of texts by a tokenizer file, from a bounded store of ids by unit.

A unit is a run of white space with the run of other characters after it. The tokenizers used here
never put a token over the border before a run of white space, and their added tokens hold none, so
the ids of a text are the ids of its units one after the other. Each worker asks the tokenizer for
a unit once and keeps the answer. The store has two halves: when the new one is full it becomes the
old one, and units that are met again move back, so frequent units stay.
"""

from __future__ import annotations

import json
import os
import re
from array import array

WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
STORED = 200_000  # units in each half of a worker's store
LONGEST = 48  # characters of a unit that is kept

_open: dict[str, Units] = {}


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters stand for themselves; the other bytes have the characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeRanks:
    """Ids of units of Latin-1 characters by tiktoken's merges, for a vocabulary in merge order.

    A mark of a word's end is the byte 0xFF, which UTF-8 text never holds. ``of`` gives None for a
    tokenizer file that is laid out in another way.
    """

    def __init__(self, vocab: dict[str, int], end: str, words: str | None):
        import regex
        import tiktoken

        chars = byte_of()
        ranks = {}
        for token, rank in vocab.items():
            ended = bool(end) and token.endswith(end)
            body = token[: -len(end)] if ended else token
            ranks[bytes(chars[c] for c in body) + b"\xff" * ended] = rank
        pattern = words or (
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.core = tiktoken.Encoding(
            "merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.words = regex.compile(words) if words else None

    @classmethod
    def of(cls, layout: dict) -> MergeRanks | None:
        model, split = layout["model"], layout["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        end = model.get("end_of_word_suffix") or ""
        special = {t["content"] for t in layout["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocab) - len(merges)
        if any(vocab.get("".join(m)) != first + i for i, m in enumerate(merges)):
            return None
        if split.get("type") == "ByteLevel" and not layout["normalizer"] and not end:
            whole = split["use_regex"] and not split["add_prefix_space"]
            return cls(vocab, end, None) if whole else None
        steps = [s["type"] for s in (layout["normalizer"] or {}).get("normalizers", [])]
        parts = split.get("pretokenizers", [])
        lowered = steps == ["NFC", "Replace", "Lowercase"] and end
        if not lowered or [s["type"] for s in parts] != ["Split", "ByteLevel"]:
            return None
        keeps = parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        return cls(vocab, end, parts[0]["pattern"]["Regex"]) if keeps else None

    def ids(self, unit: str) -> list[int]:
        if self.words is None:
            return self.core.encode_ordinary(unit)
        piece = self.core._encode_single_piece
        return [
            i for w in self.words.findall(unit.lower()) for i in piece(w.encode() + b"\xff")
        ]


def plain(unit: str) -> bool:
    """Whether a unit is Latin-1, where normal forms and letter classes are settled."""
    try:
        unit.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in unit


class Units:
    def __init__(self, path: str, stored: int = STORED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        layout = json.loads(self.tokenizer.to_str())
        self.quick = MergeRanks.of(layout)
        self.stored = stored
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fresh(self, units: set[str]) -> dict[str, bytes]:
        """Units and their ids, from the merges where they serve and the tokenizer elsewhere."""
        quick = {u: self.quick.ids(u) for u in units if plain(u)} if self.quick else {}
        rest = [u for u in units if u not in quick]
        encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        quick |= {u: e.ids for u, e in zip(rest, encoded, strict=True)}
        return {u: array("I", ids).tobytes() for u, ids in quick.items()}

    def of_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as little-endian 32-bit numbers."""
        found = list(map(self.known.get, units))
        if None in found:
            missing = {u for u, ids in zip(units, found, strict=True) if ids is None}
            fresh = {u: self.older[u] for u in missing if u in self.older}
            fresh |= self.fresh(missing - fresh.keys())
            found = [
                fresh[u] if ids is None else ids for u, ids in zip(units, found, strict=True)
            ]
            if len(self.known) + len(fresh) > self.stored:
                self.older, self.known = self.known, {}
            self.known.update((u, ids) for u, ids in fresh.items() if len(u) <= LONGEST)
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(self.of_units(UNIT.findall(text)))


def units_of(path: str, stored: int = STORED) -> Units:
    """The worker's store for a tokenizer file."""
    if path not in _open:
        _open[path] = Units(path, stored)
    return _open[path]
