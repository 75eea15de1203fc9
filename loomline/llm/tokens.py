"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and name of the rank file; both are parameters of every operator.
TOKENIZER_DIR = os.environ.get("LOOMLINE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Split of a text into pieces before merging, as published with the byte-level vocabulary (fixed value).
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZER_DIR, ranks: str = RANKS):
    """The tokenizer, loaded once in a process. Its files are read from `folder` on every executor."""
    import tiktoken

    with open(os.path.join(folder, ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("loomline", pat_str=_SPLIT, mergeable_ranks=table, special_tokens={})


def count_tokens(text: str, enc) -> int:
    """Tokens of the whole text, encoded in one piece whatever its length; merging is done by the encoder in near-linear time."""
    return len(enc.encode_ordinary(text))


def with_sizes(df: DataFrame, text: str, *keep: str, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(keep..., n_tokens): the size of `text`; null and empty texts have none. Texts don't leave the scan's task."""
    src = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "n_tokens int"])
    names = [*src.columns[:-1], "n_tokens"]

    def run(it):
        enc = encoding(folder, ranks)
        for b in it:
            sizes = [count_tokens(t, enc) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int32())], names=names)

    return src.mapInArrow(run, schema)
