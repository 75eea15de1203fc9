"""Fill containers of fixed capacity with whole documents (problem 6).

Method: vector best-fit. A container has three capacities: tokens, number of
documents, and attention cost (the sum of the squared lengths of its pieces).
Documents are taken by falling size; each goes to the open container that can
hold it under every constraint and suits it best, by one of two measures:
`norm` (the smallest weighted norm of what would be left) or `dot` (the largest
weighted product of demand and what is left, which favours containers that
have left most of what the document needs).

The attention cost may reach `COST_SHARE` of that of one full-length document, so a
document that costs nearly as much stays alone; a container always takes its first one.

Documents are dealt by the hash of their id to shards of about `SHARD_DOCUMENTS`, whose
number follows from the number of documents alone: the containers are the same
under any partitioning. Shards are packed independently, so the work is linear in the
input, and each shard loses at most its own few open containers. A shard takes
documents of all sizes, so small ones fill the gaps of large ones.

A document larger than the capacity is the only one that is split: into pieces
of full capacity, each a container of its own, and a last piece that is packed
like a document.

Defined results: null and empty texts have size 0 and take a place but no room;
ids are unique; a null id is dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.tokens import RANKS, TOKENIZER_DIR, with_sizes

#: Documents packed together; containers number about a tenth of them, all held as three small arrays.
SHARD_DOCUMENTS = 4096
#: Most documents of one container.
MAX_DOCUMENTS = 256
#: Most attention cost of a container of several documents, as a share of the square of its tokens.
COST_SHARE = 0.75
#: Most tasks of packing; a task packs its shards one after the other.
MAX_TASKS = 20_000
#: Weights of tokens, documents and attention cost in the measures.
WEIGHTS = (1.0, 0.05, 0.1)


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int = MAX_DOCUMENTS, max_cost: float | None = None, weights=WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Container of each item; `sizes` are at most `capacity`. Ties go to the container opened first. Only an item alone may cost more than `max_cost`."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    max_cost = COST_SHARE * float(capacity) ** 2 if max_cost is None else max_cost
    scale = np.array([capacity, max_docs, max_cost], float)
    w = np.asarray(weights, float)
    n = len(sizes)
    out = np.zeros(n, np.int64)
    room = np.empty((3, max(16, n // 4)))  # what is left of each capacity, by open container
    name = np.empty(room.shape[1], np.int64)
    used = opened = 0
    order = np.argsort(-sizes, kind="stable")
    least = sizes[order[-1]] if n else 0
    for i in order:
        s = float(sizes[i])
        need = np.array([s, 1.0, s * s])
        best = -1
        if used:
            r = room[:, :used]
            left = r - need[:, None]
            fits = (left >= 0).all(0)
            if fits.any():
                if rule == "norm":
                    measure = (w[:, None] * (left / scale[:, None]) ** 2).sum(0)
                else:
                    measure = -(w[:, None] * (need / scale)[:, None] * (r / scale[:, None])).sum(0)
                best = int(np.argmin(np.where(fits, measure, np.inf)))
        if best < 0:
            if used == room.shape[1]:
                room, name = np.concatenate([room, np.empty_like(room)], 1), np.concatenate([name, np.empty_like(name)])
            best, used, opened = used, used + 1, opened + 1
            room[:, best], name[best] = scale, opened - 1
        room[:, best] -= need
        out[i] = name[best]
        if room[0, best] < max(least, 1) or room[1, best] < 1 or room[2, best] < least * least:  # full: nothing that comes can enter
            used -= 1
            room[:, best : used] = room[:, best + 1 : used + 1].copy()
            name[best : used] = name[best + 1 : used + 1].copy()
    return out


_OUT = "container_id string, {key} {kind}, piece int, token_start int, n_tokens int"


def pack(
    documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", *, max_docs: int = MAX_DOCUMENTS, max_cost: float | None = None,
    weights=WEIGHTS, rule: str = "norm", shard_documents: int = SHARD_DOCUMENTS, folder: str = TOKENIZER_DIR, ranks: str = RANKS,
) -> DataFrame:
    """(container_id, key, piece, token_start, n_tokens): one row for each document, several for one that had to be split."""
    docs = documents.where(F.col(key).isNotNull())
    sized = with_sizes(docs, text, key, folder=folder, ranks=ranks)
    kind = dict(sized.dtypes)[key]
    shards = max(1, -(-docs.count() // shard_documents))
    shard = F.pmod(F.xxhash64(key), F.lit(shards))
    # only (shard, id, size) is shuffled; the number of tasks is stated, so small data isn't drawn together into one
    dealt = sized.select(shard.alias("shard"), key, "n_tokens").repartition(min(shards, MAX_TASKS), "shard").sortWithinPartitions("shard", F.desc("n_tokens"), key)

    def run(it):
        held, at = [], None
        for b in it:
            s = b.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(s)) + 1, len(s)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi == lo:
                    continue
                if at is not None and s[lo] != at:
                    yield from _pack_shard(pa.Table.from_batches(held), at, key, capacity, max_docs, max_cost, weights, rule)
                    held = []
                at = int(s[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _pack_shard(pa.Table.from_batches(held), at, key, capacity, max_docs, max_cost, weights, rule)

    return dealt.mapInArrow(run, _OUT.format(key=f"`{key}`", kind=kind))


def _pack_shard(t: pa.Table, shard: int, key: str, capacity: int, max_docs: int, max_cost: float | None, weights, rule: str):
    size = t["n_tokens"].to_numpy().astype(np.int64)
    whole = np.where(size > capacity, (size - 1) // capacity, 0)  # full pieces of split documents; the last piece is never empty
    rest = size - whole * capacity
    box = best_fit(rest, capacity, max_docs, max_cost, weights, rule)
    doc = np.concatenate([np.arange(len(size)), np.repeat(np.arange(len(size)), whole)])
    k = np.concatenate([whole, np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)])
    names = np.concatenate([box, (box.max() + 1 if len(box) else 0) + np.arange(whole.sum())])
    n = np.concatenate([rest, np.full(whole.sum(), capacity)])
    yield from pa.table({
        "container_id": pa.array([f"{shard}-{x}" for x in names.tolist()]), key: t[key].combine_chunks().take(pa.array(doc)),
        "piece": pa.array(k.astype(np.int32)), "token_start": pa.array((k * capacity).astype(np.int32)), "n_tokens": pa.array(n.astype(np.int32)),
    }).to_batches(max_chunksize=16384)


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """(container_id, n_documents, n_tokens, unused_tokens) of each container."""
    n = F.sum("n_tokens").cast("long")
    return packed.groupBy("container_id").agg(F.count("*").alias("n_documents"), n.alias("n_tokens"), (F.lit(capacity) - n).alias("unused_tokens"))


def checks(packed: DataFrame, documents: DataFrame, capacity: int, key: str = "doc_id", max_docs: int = MAX_DOCUMENTS, max_cost: float | None = None) -> DataFrame:
    """One row that says whether a packing keeps its promises: how many documents there are and how many are packed, split, or cut
    although they fit; containers beyond a capacity; and whether the containers are at most a twentieth more than their tokens need."""
    max_cost = COST_SHARE * float(capacity) ** 2 if max_cost is None else max_cost
    docs = packed.groupBy(key).agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.struct("piece", "token_start", "n_tokens")).alias("last"))
    by_doc = docs.agg(
        F.count("*").alias("packed"), F.count_if(F.col("n") > capacity).alias("split"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("cut"),
        F.count_if((F.col("last.piece") + 1 != F.col("pieces")) | (F.col("last.token_start") + F.col("last.n_tokens") != F.col("n"))).alias("torn"),
    )
    boxes = packed.groupBy("container_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("cost"))
    by_box = boxes.agg(F.count_if((F.col("n") > capacity) | (F.col("k") > max_docs) | ((F.col("k") > 1) & (F.col("cost") > max_cost))).alias("overfull"), (F.count("*") <= F.ceil(F.sum("n") / capacity * 1.05) + 1).alias("tight"))
    total = documents.where(F.col(key).isNotNull()).agg(F.count("*").alias("documents"))
    return total.join(by_doc, F.lit(True)).join(by_box, F.lit(True))
