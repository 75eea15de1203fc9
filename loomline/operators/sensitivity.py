"""Grading and masking of sensitive spans."""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline import constants as C


#: Literals of which a match of the pattern must hold one; finding these costs far less than the pattern.
_HOLDS = {
    C.SECRET_PATTERNS[0]: ("gho_", "ghp_", "ghs_", "ghu_"), C.SECRET_PATTERNS[1]: ("sk-ant",), C.SECRET_PATTERNS[2]: ("sk-",), C.SECRET_PATTERNS[3]: ("xox",), C.SECRET_PATTERNS[4]: (":", "="),
    C.CREDENTIAL_NAME: ("API_KEY", "TOKEN", "SECRET", "PASSWORD", "PRIVATE_KEY"), C.EMAIL: ("@",), C.HOME_PATH: ("/home/",), C.PRIVATE_NETWORK: ("10.", "172.", "192.168.", "100."),
}


def _occurs(c: Column, pattern: str) -> Column:
    hit = c.rlike(pattern)
    if pattern in _HOLDS:
        hit = reduce(or_, [c.contains(x) for x in _HOLDS[pattern]]) & hit
    return F.coalesce(hit, F.lit(False))


def quick_level(c: Column) -> Column:
    """Level by presence of patterns alone, in the JVM.

    It differs from `level` only where a credential's name lies inside a span that
    begins earlier and is no secret: there this function says secret.
    """
    secret, other = F.lit(False), F.lit(False)
    for kind, pattern, _ in C.DETECTORS:
        hit = _occurs(c, pattern)
        if kind in ("secret", "credential_name"):
            secret = secret | hit
        else:
            other = other | hit
    return F.when(secret, "secret").when(other, "personal").otherwise("internal")


def hit_counts(c: Column) -> dict[str, Column]:
    """Matches of each kind of detector (the five secret patterns together)."""
    out: dict[str, Column] = {}
    for kind, pattern, _ in C.DETECTORS:
        n = F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))
        out[kind] = out[kind] + n if kind in out else n
    return out


_COMPILED = [(rank, kind, re.compile(pattern), label) for rank, (kind, pattern, label) in enumerate(C.DETECTORS)]
_LABELS = {kind: label for kind, _, label in C.DETECTORS}


def spans(text: str) -> list[tuple[str, int, int]]:
    """Merged hits (kind, start, end) in order.

    A hit opens a span of its own where it starts beyond the farthest end of all hits
    before it (by start, end and rank). A span with a secret in it is a secret, any other
    has the kind of its first hit.
    """
    hits = sorted((m.start(), m.end(), rank, kind) for rank, kind, p, _ in _COMPILED for m in p.finditer(text))
    reach = list(accumulate((end for _, end, *_ in hits), max))
    opens = [i for i, hit in enumerate(hits) if not i or hit[0] > reach[i - 1]]
    groups = [hits[i:j] for i, j in zip(opens, [*opens[1:], len(hits)])]
    return [("secret" if any(k == "secret" for *_, k in g) else g[0][3], g[0][0], reach[j - 1]) for g, j in zip(groups, [*opens[1:], len(hits)])]


def mask_text(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """`text` with numbered placeholders for its merged hits."""
    hits = spans(text)
    parts, at = [], 0
    for n, (kind, start, end) in enumerate(hits, 1):
        parts += [text[at:start], f"[REDACTED_{_LABELS[kind]}_{n}]"]
        at = end
    return "".join([*parts, text[at:]]), hits


_MASKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.StringType()), T.StructField("n_hits", T.IntegerType())])


def _level(hits) -> str:
    kinds = {k for k, *_ in hits}
    return "secret" if kinds & {"secret", "credential_name"} else "personal" if kinds else "internal"


@F.pandas_udf(_MASKED)
def _mask_udf(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, None, None))
        else:
            masked, hits = mask_text(t)
            rows.append((masked, _level(hits), len(hits)))
    return pd.DataFrame(rows, columns=["text", "level", "n_hits"])


def masked(c: Column) -> Column:
    """Struct of the masked text, its exact level and the number of merged hits; null for null.

    Offsets of all matches aren't available in the JVM, so texts with a hit go through
    an Arrow batch; the others are decided by `quick_level` and never leave it.
    """
    hot = quick_level(c) != "internal"
    u = _mask_udf(F.when(hot, c))
    return F.when(c.isNull(), F.lit(None).cast(_MASKED)).otherwise(
        F.struct(F.coalesce(u["text"], c).alias("text"), F.coalesce(u["level"], F.lit("internal")).alias("level"), F.coalesce(u["n_hits"], F.lit(0)).alias("n_hits"))
    )


_KEYS = ((re.compile(r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+"), "Bearer [REDACTED]"), (re.compile(r"(?i)(api[_-]?key['\"]?\s*[:=]\s*['\"]?)[^\s'\",;]+"), r"\1[REDACTED]"), (re.compile("|".join(C.SECRET_PATTERNS[:4])), "[REDACTED]"))


def redact_error(message: str) -> str:
    """An error message without bearer tokens and keys."""
    for pattern, shown in _KEYS:
        message = pattern.sub(shown, message)
    return message
