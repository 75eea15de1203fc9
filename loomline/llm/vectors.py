"""Columnar tokenisation of a batch of texts, shared by the text operators.

A batch of texts is joined, cut by one regular expression in C and factorised,
so that per-token work is done once per distinct token and everything else is
numpy arithmetic on integer codes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Texts are joined by this character; it is blanked inside texts.
SEP = "\x00"


@dataclass
class TokenBatch:
    """Tokens of a batch: `code[i]` indexes `vocab`, `doc[i]` is the row of token i."""

    code: np.ndarray
    vocab: list[str]
    doc: np.ndarray
    n_docs: int

    def starts(self) -> np.ndarray:
        """First token of each row, with the end appended."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def tokenize(texts: list[str | None], pattern: re.Pattern[str]) -> TokenBatch:
    """Cut `texts` (null counts as empty) by `pattern`, which must match SEP as a token of its own."""
    big = SEP.join([t.replace(SEP, " ") if t and SEP in t else (t or "") for t in texts])
    toks = pattern.findall(big)
    if not toks:
        return TokenBatch(np.zeros(0, np.int64), [], np.zeros(0, np.int64), len(texts))
    code, vocab = pd.factorize(np.array(toks, dtype=object))
    vocab = list(vocab)
    if SEP in vocab:
        is_sep = code == vocab.index(SEP)
        doc = np.cumsum(is_sep)
        keep = ~is_sep
        code, doc = code[keep], doc[keep]
    else:
        doc = np.zeros(len(code), np.int64)
    return TokenBatch(code, vocab, doc, len(texts))


def stable_hash(token: str) -> int:
    """FNV-1a over UTF-8, the same in every process."""
    h = 0xCBF29CE484222325
    for b in token.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def batches(frame_iter, rows: int = 8192):
    """Cut Arrow record batches so that no batch has more than `rows` rows."""
    for b in frame_iter:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
