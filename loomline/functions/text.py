"""Column functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (`trim` only takes spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def non_empty(c: Column) -> Column:
    """Null where the string is empty, so that `coalesce` falls through."""
    return F.when(c != "", c)


def starts_with_any(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def contains_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def word_hits(lower: Column, words) -> Column:
    """How many of `words` occur as whole words."""
    out = F.lit(0)
    for w in words:
        out = out + F.when(lower.rlike(rf"\b{w}\b"), 1).otherwise(0)
    return out


def cut_at_word(c: Column, chars: int) -> Column:
    """The first `chars` characters, back to the last space if there is one."""
    cut = F.substring(c, 1, chars)
    return F.when(F.length(c) <= chars, c).when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r"(?s) [^ ]*\z", "")).otherwise(cut)


def brief(c: Column, chars: int) -> Column:
    """At most `chars` characters on one line, cut at a word, with an ellipsis where cut."""
    t = collapse(c)
    cut = F.substring(t, 1, chars - 1)
    inside = (F.substring(t, chars, 1) != " ") & (F.instr(cut, " ") > 0)
    word = F.when(inside, F.regexp_replace(cut, r" [^ ]*\z", "")).otherwise(cut)
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(F.rtrim(word), F.lit("…")))


def short_hash(c: Column, digits: int, bits: int = 256) -> Column:
    """The first digits of a SHA-1 (bits=1) or SHA-2 digest."""
    return F.substring(F.sha1(c) if bits == 1 else F.sha2(c, bits), 1, digits)


def tokens_of(length: Column) -> Column:
    """Estimate of tokens from a number of characters: a quarter, at least one."""
    return F.greatest(F.lit(1), F.ceil(length / F.lit(4.0))).cast("int")
