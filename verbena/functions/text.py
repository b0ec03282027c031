"""Column functions on text and seeded draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = "[a-z]+"
MASK = "[MASK]"


def tokens_of(text: Column | str) -> Column:
    """Array of the lower-case letter runs of a text, in reading order."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN_PATTERN), F.lit(0))


def seeded_hash(*parts: Column | str | int) -> Column:
    """md5 over the parts joined by colons: the same draw on every run and retry."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def share_threshold(share: float) -> str:
    """The eight hex digits below which ``share`` of all hashes lie."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    if share == 1:
        return "g"  # sorts after every hex digit
    return format(int(share * 2**32), "08x")


def drawn(hashed: Column, share: float) -> Column:
    """True for the given share of hashes."""
    return hashed < F.lit(share_threshold(share))


def uniform(hashed: Column) -> Column:
    """A double in [0, 1) from the first eight hex digits of a hash."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def is_one_of(column: Column, words: list[str]) -> Column:
    """Membership in a word list held in the plan itself."""
    return column.isin(*words) if words else F.lit(False)
