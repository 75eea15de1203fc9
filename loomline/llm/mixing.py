"""Mix sources to target shares of all tokens (problem 7).

Method: Poisson replication. With T the tokens of all documents, a source of
share p needs the mean repetition rate p * T / (its tokens). A document is used
N times, N drawn by inverting a Poisson distribution at a uniform number made
from the hash of its id and a seed, cut off at the source's `max_repeats`; the
distribution's mean is raised so that the mean *after* the cut is the rate
wanted. A source whose rate reaches `max_repeats` gives every document that
often, and cannot reach its share. Draws are a function of id and seed, so a
task run again draws the same. Documents are exploded by their count and
shuffled globally by the hash of id and copy.

Names of sources agree when letter case and blanks around them are ignored.
Defined results: documents without a source, or of one without a target, count
towards T and are not used; a target without documents reaches a share of 0; a
null or negative `max_repeats` counts as 0 and a null share as 0; of several
targets of one source the first by share counts.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.tokens import RANKS, TOKENIZER_DIR, with_sizes
from loomline.session import cut_lineage

#: Most targets that are broadcast.
MAX_TARGETS = 100_000


def source_key(c: Column) -> Column:
    s = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(s != "", s)


def poisson_table(rate: float, cap: int) -> tuple[float, list[float] | None]:
    """Mean of the Poisson distribution whose mean after a cut at `cap` is `rate`, and P(N <= k) for k below `cap`.

    The table ends where it reaches 1. It is None where every document is used `cap` times.
    """
    if cap <= 0 or rate <= 0:
        return 0.0, []
    if rate >= cap:
        return math.inf, None

    def below(mean: float) -> list[float]:
        total, out = 0.0, []
        for k in range(cap):
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            if total >= 1 - 1e-15:
                break
            out.append(total)
        return out

    def cut_mean(mean: float) -> float:
        return sum(1 - x for x in below(mean))

    lo, hi = 0.0, max(rate, 1e-9)
    while cut_mean(hi) < rate and hi < 64 * cap + 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid == 0 or cut_mean(mid) < rate else (lo, mid)
    return hi, below(hi)


_PLANNED = "key string, source string, share double, cap int, tokens long, all_tokens long, rate double, mean double, steps array<double>"


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: tokens there are, rate wanted, and the inverted distribution as an array of thresholds.

    The only thing brought to the driver is T; distributions are inverted where the targets are.
    """
    want = targets.select(F.col("source").alias("source"), source_key(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
    want = want.where("key IS NOT NULL").groupBy("key").agg(F.max(F.struct("share", "cap", "source")).alias("w")).select("key", "w.source", "w.share", F.col("w.cap").cast("int").alias("cap"))
    totals = sizes.groupBy("key").agg(F.sum("n_tokens").cast("long").alias("tokens"))
    have = sizes.agg(F.sum("n_tokens").cast("long")).first()[0] or 0
    rate = F.when(F.col("tokens") > 0, F.col("share") * F.lit(have) / F.col("tokens")).otherwise(F.lit(0.0))
    rows = want.join(totals, "key", "left").select("key", "source", "share", "cap", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.lit(have).cast("long").alias("all_tokens"), rate.alias("rate"))

    def invert(it):
        for b in it:
            got = [poisson_table(min(r, float(c)), c) for r, c in zip(b.column(6).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m for m, _ in got], pa.float64()), pa.array([s for _, s in got], pa.list_(pa.float64()))], names=_PLANNED_NAMES)

    return cut_lineage(rows.mapInArrow(invert, _PLANNED))


_PLANNED_NAMES = [x.split()[0] for x in _PLANNED.split(", ")]


def draws(sizes: DataFrame, planned: DataFrame, key: str, seed: int) -> DataFrame:
    """`sizes` of the planned sources with `n_uses`, the number of times the document is drawn.

    Up to `MAX_TARGETS` targets are broadcast; more are joined by the source, whose hot keys adaptive execution splits.
    """
    # 53 bits of the hash as a number in [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.col(key)), 11).cast("double") / F.lit(float(2**53))
    small = planned.select("key", "source", "steps", "cap")
    if planned.count() <= MAX_TARGETS:
        small = F.broadcast(small)
    joined = sizes.join(small, "key").withColumn("_u", u)
    return joined.withColumn("n_uses", F.when(F.col("steps").isNull(), F.col("cap")).otherwise(F.size(F.filter("steps", lambda p: F.col("_u") >= p)))).drop("_u", "steps", "cap")


def sizes_of(documents: DataFrame, key: str = "doc_id", text: str = "text", *, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(id, source key, tokens), written once: the texts are tokenised one time for plan, draws and report."""
    keyed = documents.select(key, source_key(F.col("source")).alias("key"), F.col(text).alias("_txt"))
    return cut_lineage(with_sizes(keyed, "_txt", key, "key", folder=folder, ranks=ranks))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", *, seed: int = 7, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    The selection has a row (id, source, copy, n_tokens) for each use, in global
    random order; texts are joined to it by id where they are wanted. The report
    has a row for each target with the tokens wanted and drawn and the shares.
    """
    return mixed(sizes_of(documents, key, text, folder=folder, ranks=ranks), targets, key, seed)


def mixed(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """`mix` of documents whose sizes are known (`sizes_of`)."""
    planned = plan(sizes, targets)
    drawn = draws(sizes, planned, key, seed)
    uses = drawn.where("n_uses > 0").select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_uses"))).alias("copy"))
    place = F.xxhash64(F.lit(seed + 1).cast("long"), key, "copy")
    selection = uses.withColumn("_p", place).repartitionByRange("_p", key, "copy").sortWithinPartitions("_p", key, "copy").select(key, "source", "copy", "n_tokens")
    got = drawn.groupBy("key").agg(F.sum(F.col("n_tokens").cast("long") * F.col("n_uses")).alias("drawn"), F.sum(F.when(F.col("n_uses") > 0, 1).otherwise(0)).cast("long").alias("documents"), F.max("n_uses").alias("most_uses"))
    total = got.agg(F.sum("drawn").alias("drawn_all"))
    report = (
        planned.join(got, "key", "left").crossJoin(F.broadcast(total))
        .select(
            "source", "share", F.col("cap").alias("max_repeats"), "tokens", "all_tokens", F.col("rate").alias("wanted_repeats"),
            F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.when(F.col("all_tokens") > 0, F.coalesce("drawn", F.lit(0)) / F.col("all_tokens")).alias("share_of_target_size"),
            F.when(F.col("drawn_all") > 0, F.coalesce("drawn", F.lit(0)) / F.col("drawn_all")).alias("share_of_selection"),
            (F.col("tokens") * F.col("cap") >= F.col("share") * F.col("all_tokens")).alias("reachable"),
        )
    )
    return selection, report


def checks(selection: DataFrame, sizes: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source, within_cap, as_wanted, unique): for each target whether no document is used more often than it may, whether the tokens drawn lie
    within six standard deviations of those wanted (all there are, for a source that can't reach its share), and whether no use occurs twice."""
    planned = plan(sizes, targets)
    uses = selection.groupBy("source", key).agg(F.count("*").alias("k"), F.max("copy").alias("last"), F.countDistinct("copy").alias("copies"), F.max("n_tokens").cast("long").alias("n"))
    got = uses.groupBy("source").agg(F.max("k").alias("most"), F.sum(F.col("k") * F.col("n")).alias("drawn"), F.min((F.col("k") == F.col("copies")) & (F.col("k") == F.col("last"))).alias("unique"))
    spread = sizes.groupBy("key").agg(F.sum(F.col("n_tokens").cast("double") ** 2).alias("squares"))
    rate = F.least(F.col("rate"), F.col("cap").cast("double"))
    near = F.abs(F.coalesce("drawn", F.lit(0)) - rate * F.col("tokens")) <= F.when(F.col("rate") >= F.col("cap"), F.lit(0.5)).otherwise(6 * F.sqrt(F.coalesce("squares", F.lit(0.0)) * rate) + 0.5)
    return planned.join(spread, "key", "left").join(got, "source", "left").select("source", (F.coalesce("most", F.lit(0)) <= F.col("cap")).alias("within_cap"), near.alias("as_wanted"), F.coalesce("unique", F.lit(True)).alias("unique"))
