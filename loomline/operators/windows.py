"""Overlapping token-budget windows over the turns of a session, and their routing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions.text import collapse, short_hash, tokens_of
from loomline.operators.scan import running_total
from loomline.session import cut_lineage

FAMILIES = tuple(C.FAMILY_PATTERNS)


def line_length(text: Column, chars: int = C.TURN_CHARS[0]) -> Column:
    """Characters of a turn's line in a prompt, with its text on one line and clipped. Pass masked text."""
    body = F.length(collapse(F.coalesce(text, F.lit(""))))
    clipped = F.least(body, F.lit(chars + 1))
    tool = F.when(F.coalesce("tool_name", F.lit("")) != "", F.length("tool_name") + 6).otherwise(0)
    return F.length("turn_id") + F.length(F.col("idx").cast("string")) + F.length("actor") + tool + clipped + len("turn_id= idx= actor=: ")


def token_estimate(text: Column, chars: int = C.TURN_CHARS[0]) -> Column:
    return tokens_of(line_length(text, chars))


def family_flags(text: Column) -> Column:
    """Bits of the families whose pattern occurs. No pattern crosses a line, so the flags of a window are those of its turns."""
    out = F.lit(0)
    for i, p in enumerate(C.FAMILY_PATTERNS.values()):
        out = out + F.when(text.rlike(p), 1 << i).otherwise(0)
    return out


def routed(flags: Column) -> Column:
    """Array of the passes of a window, in order. A model signal alone asks for the authorization pass."""
    bit = lambda f: flags.bitwiseAND(F.lit(1 << FAMILIES.index(f))) > 0
    passes = [F.when(bit(f) | bit("model_routing") if f == "authorization_limit" else bit(f), f) for f in C.PASS_CODES]
    return F.array_compact(F.array(*passes))


def passes_for(flags: Column, strategy: str = "per_family") -> Column:
    if strategy == "combined":
        return F.array(F.lit("all"))
    if strategy == "per_family":
        return routed(flags)
    raise ValueError("strategy is 'per_family' or 'combined'")


def greedy(tokens: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [start, end) over a list: the rule on its own, for tests and small inputs."""
    out, start, n = [], 0, len(tokens)
    pre = np.r_[0, np.cumsum(tokens)]
    while start < n:
        end = max(start + 1, int(np.searchsorted(pre, pre[start] + limit, "right")) - 1)
        out.append((start, end))
        if end >= n:
            break
        start = max(start + 1, int(np.searchsorted(pre, pre[end] - overlap, "right")) - 1) if overlap > 0 else end
    return out


def _block(tokens: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a window that begins at each turn: where it ends, and where the next one begins."""
    pre = np.r_[0, np.cumsum(tokens)]
    at = np.arange(len(tokens))
    end = np.maximum(at + 1, np.searchsorted(pre, pre[:-1] + limit, "right") - 1)
    return end, np.maximum(at + 1, np.searchsorted(pre, pre[end] - overlap, "right") - 1) if overlap > 0 else end


_NAMES = ["session_id", "block", "entry", "exit", "n_windows", "window_index", "start_idx", "end_idx", "n_turns", "tokens", "flags"]
_SCAN = "session_id string, block long, entry int, exit int, n_windows long, window_index long, start_idx int, end_idx int, n_turns int, tokens long, flags int"


def windows(turns: DataFrame, limit: int = C.MAX_WINDOW_TOKENS, overlap: int = C.OVERLAP_TOKENS, block: int | None = None) -> DataFrame:
    """Windows of (session_id, idx, tokens, flags); turns of a session are unique by idx and have a token or more.

    A window takes turns while their tokens stay within `limit` (the first always);
    the next begins where at least `overlap` tokens are repeated, and one turn later
    at the earliest. Where a window begins thus depends on the one before, but a window
    spans no more than `limit` turns. So a session is cut into blocks of `block` turns,
    each with the first turns of the next one as a margin, and blocks are worked on apart:
    for each of its first turns a block tells at which turn of the next block the windows
    go on if they enter there. Ways from different entries soon meet, so a block's table is a
    few rows. Following the tables from block to block (a few numbers a block) gives every
    block its entry, from which its windows are cut. No task holds more than one block.
    Only narrow columns are shuffled.
    """
    size = max(block or 4096, 2 * (limit + 1))
    ids = turns.select("session_id", F.col("idx").cast("long").alias("idx"), F.lit(1).alias("_one"))
    placed = turns.select("session_id", F.col("idx").cast("long").alias("idx"), F.col("tokens").cast("int").alias("tokens"), F.col("flags").cast("int").alias("flags")).join(running_total(ids, "session_id", "idx", "_one", "pos"), ["session_id", "idx"])
    own = F.floor(F.col("pos") / size)
    blocks = F.when((F.col("pos") % size <= limit) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = placed.select("session_id", F.explode(blocks).alias("block"), "pos", "idx", "tokens", "flags")

    def cut(it, entered: bool):
        """Windows of block 0, and tables of the others; with `entered`, windows of blocks whose rows carry their entry and first window."""
        for sid, b, t in _blocks(it):
            idx, tok, flag, n = t[0], t[1], t[2], len(t[0])
            end, nxt = _block(tok, limit, overlap)
            if b and not entered:
                yield _ways(sid, b, end, nxt, n, size, limit)
                continue
            at, k = (int(t[3][0]), int(t[4][0])) if entered else (0, 0)
            pre, starts = np.r_[0, np.cumsum(tok)], []
            while at < min(n, size):
                starts.append(at)
                if end[at] >= n:
                    at = n
                    break
                at = int(nxt[at])
            s = np.array(starts, np.int64)
            e = end[s]
            bits = np.array([np.bitwise_or.reduce(flag[x:y]) for x, y in zip(s, e)], np.int32)
            m = len(s)
            null = pa.nulls(m, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([sid] * m, pa.string()), pa.array(np.full(m, b)), null, null, pa.nulls(m, pa.int64()), pa.array(k + np.arange(m)), pa.array(idx[s].astype(np.int32)), pa.array(idx[e - 1].astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(pre[e] - pre[s]), pa.array(bits)], names=_NAMES)
            if not entered and n > size:  # more blocks follow: tell where they are entered
                yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([b]), pa.array([0], pa.int32()), pa.array([at - size if size <= at < n else -1], pa.int32()), pa.array([m], pa.int64()), *[pa.nulls(1, k_) for k_ in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())]], names=_NAMES)

    first = cut_lineage(rows.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "pos").select("session_id", "block", "idx", "tokens", "flags").mapInArrow(lambda it: cut(it, False), _SCAN))
    ways = first.where("entry IS NOT NULL").select("session_id", "block", "entry", "exit", "n_windows")
    columns = ("session_id", F.col("window_index").cast("int").alias("window_index"), "start_idx", "end_idx", "n_turns", "tokens", "flags")
    if ways.isEmpty():  # no session has a second block
        return first.select(*columns)
    entries = ways.repartition("session_id").sortWithinPartitions("session_id", "block", "entry").mapInArrow(_follow, "session_id string, block long, entry int, k long")
    later = rows.where("block > 0").join(entries, ["session_id", "block"]).repartition("session_id", "block").sortWithinPartitions("session_id", "block", "pos")
    rest = later.select("session_id", "block", "idx", "tokens", "flags", "entry", "k").mapInArrow(lambda it: cut(it, True), _SCAN)
    return first.where("start_idx IS NOT NULL").unionByName(rest).select(*columns)


def _blocks(it):
    """(session, block, columns after these two as arrays) of each block of a stream sorted by session and block."""
    held, key = [], None
    for b in it:
        if not b.num_rows:
            continue
        sid, blk = b.column(0), b.column(1).to_numpy()
        new = np.r_[True, pc.not_equal(sid.slice(1), sid.slice(0, len(sid) - 1)).to_numpy(zero_copy_only=False) | (np.diff(blk) != 0)] if len(sid) > 1 else np.ones(1, bool)
        edges = np.r_[np.flatnonzero(new), len(sid)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            k = (sid[int(lo)].as_py(), int(blk[lo]))
            if key is not None and k != key:
                yield *key, [np.concatenate(c) for c in zip(*held)]
                held = []
            key = k
            held.append([b.column(j).slice(lo, hi - lo).to_numpy() for j in range(2, b.num_columns)])
    if held:
        yield *key, [np.concatenate(c) for c in zip(*held)]


def _ways(sid: str, b: int, end: np.ndarray, nxt: np.ndarray, n: int, size: int, limit: int) -> pa.RecordBatch:
    """Table of a block: from each entry (until the next row's) the exit into the next block, -1 where the session ends, and the windows begun."""
    m = min(n, size)
    to, count = np.full(m, -1, np.int64), np.ones(m, np.int64)
    e, x = end.tolist(), nxt.tolist()
    out, num = to.tolist(), count.tolist()
    for s in range(m - 1, -1, -1):
        if e[s] >= n:
            continue
        j = x[s]
        if j >= size:
            out[s] = j - size
        else:
            out[s], num[s] = out[j], num[j] + 1
    heads = min(m, limit + 1)
    pairs = np.array([out[:heads], num[:heads]])
    keep = np.flatnonzero(np.r_[True, (np.diff(pairs, axis=1) != 0).any(0)])
    k = len(keep)
    return pa.RecordBatch.from_arrays([pa.array([sid] * k, pa.string()), pa.array(np.full(k, b)), pa.array(keep.astype(np.int32)), pa.array(pairs[0][keep].astype(np.int32)), pa.array(pairs[1][keep]), *[pa.nulls(k, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())]], names=_NAMES)


def _follow(it):
    """Entry and number of the first window of each block, from the tables in order of session, block and entry."""
    sid = at = None
    begun, out, table = 0, [], []
    block = None

    def step():
        nonlocal at, begun
        hit = None
        for entry, exit_, n in table:
            if entry <= at:
                hit = (exit_, n)
        if block:
            out.append((sid, block, at, begun))
        at, begun = hit[0], begun + hit[1]

    for b in it:
        for s, k, entry, exit_, n in zip(*(c.to_pylist() for c in b.columns)):
            if (s, k) != (sid, block):
                if table and at >= 0:
                    step()
                table = []
                if s != sid:
                    at, begun = 0, 0
                sid, block = s, k
            table.append((entry, exit_, n))
    if table and at >= 0:
        step()
    cols = list(zip(*out)) if out else [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()))], names=["session_id", "block", "entry", "k"])


def window_id() -> Column:
    return F.concat(F.lit("cie_win_"), short_hash(F.concat_ws(":", "session_id", "window_index", "start_idx", "end_idx"), 16, bits=1))


def members(wins: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns of each window. Windows are cut into blocks of positions, so the join is an equality on (session, block) and a hot session spreads over its blocks."""
    block = 64
    w = wins.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor(F.col("end_idx") / block))))
    t = turns.withColumn("_b", F.floor(F.col("idx") / block))
    return w.join(t.drop("tokens", "flags"), ["session_id", "_b"]).where("idx BETWEEN start_idx AND end_idx").drop("_b")


def planned(wins: DataFrame, strategy: str = "per_family") -> DataFrame:
    """(window_id, session_id, window_index, family, pass_order): the passes of each window."""
    return wins.withColumn("window_id", window_id()).select("window_id", "session_id", "window_index", F.posexplode(passes_for(F.col("flags"), strategy)).alias("pass_order", "family"))


def no_signal(wins: DataFrame) -> DataFrame:
    """Windows that no family claims, as rows for the ledger."""
    return wins.where(F.size(routed(F.col("flags"))) == 0).select(window_id().alias("window_id"), "session_id", F.lit("no_signal").alias("family"), F.lit("no_signal").alias("status"))


def remaining(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned passes without a finished run in the ledger."""
    done = ledger.where(F.col("status").isin("processed", "no_signal")).select("window_id", "family").distinct()
    return plan.join(done, ["window_id", "family"], "left_anti")
