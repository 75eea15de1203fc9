"""Scoring one extractor's records against another's, and statistics of runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline import constants as C


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0 or null."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def f1(recall: Column, agreement: Column) -> Column:
    return F.when(recall + agreement > 0, 2 * recall * agreement / (recall + agreement)).otherwise(F.lit(0.0))


def wilson(hits: Column, total: Column, z: float = C.Z_95) -> tuple[Column, Column]:
    """Bounds of the confidence interval of a proportion, within [0, 1]; (0, 0) for nothing."""
    p = hits / total
    den = 1 + z * z / total
    mid = p + z * z / (2 * total)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    ok = total > 0
    return F.when(ok, F.greatest(F.lit(0.0), (mid - spread) / den)).otherwise(F.lit(0.0)), F.when(ok, F.least(F.lit(1.0), (mid + spread) / den)).otherwise(F.lit(0.0))


def bucket(n: Column) -> Column:
    return F.when(n <= C.BUCKET_SHORT, "short").when(n <= C.BUCKET_MEDIUM, "medium").otherwise("long")


def matched_counts(gold: DataFrame, candidates: DataFrame, keys=("session_id", "code")) -> DataFrame:
    """(keys, gold, candidates, matched): records of a key are interchangeable, so greedy one-to-one matching finds the smaller count."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("gold"))
    c = candidates.groupBy(*keys).agg(F.count("*").alias("candidates"))
    n = lambda c_: F.coalesce(c_, F.lit(0)).cast("long")
    return g.join(c, list(keys), "full").select(*keys, n(F.col("gold")).alias("gold"), n(F.col("candidates")).alias("candidates"), F.least(n(F.col("gold")), n(F.col("candidates"))).alias("matched"))


def scores(counts: DataFrame, *by: str) -> DataFrame:
    """Recall, agreement, F1 and intervals of matched counts, in total or by columns; an empty input gives one row of zeros."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    s = counts.groupBy(*by).agg(total("gold"), total("candidates"), total("matched"))
    r, a = ratio(F.col("matched"), F.col("gold")), ratio(F.col("matched"), F.col("candidates"))
    (rl, rh), (al, ah) = wilson(F.col("matched"), F.col("gold")), wilson(F.col("matched"), F.col("candidates"))
    cols = {"recall": r, "agreement": a, "f1": f1(r, a), "recall_low": rl, "recall_high": rh, "agreement_low": al, "agreement_high": ah}
    return s.select(*by, "gold", "candidates", "matched", *[F.round(v, 6).alias(k) for k, v in cols.items()])


def ngrams(text: Column, n: int = 4) -> Column:
    """Array of the runs of `n` words of a text in lower case; none for shorter texts."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def strict_matches(gold: DataFrame, candidates: DataFrame, n: int = 4) -> DataFrame:
    """(session_id, code, matched) of ordered first-fit matching on quotes; `ord` orders the records of a key and is unique in it.

    Candidates of a (session, code) in order take the first unused gold record that shares a run of `n` words. The rule
    depends on the order and isn't a maximum matching. Only pairs that share a run are made, by a join on the runs; a stream over
    a key's pairs in order keeps the gold records taken so far.
    """
    key = ["session_id", "code"]
    runs = lambda d, name: d.select(*key, F.col("ord").cast("string").alias(name), F.explode(F.array_distinct(ngrams(F.col("quote"), n))).alias("run"))
    places = lambda d, name: d.select(*key, F.col("ord").cast("string").alias(name), F.row_number().over(Window.partitionBy(*key).orderBy("ord")).alias(f"{name}_at"))
    pairs = runs(gold, "g").join(runs(candidates, "c"), [*key, "run"]).select(*key, "c", "g").distinct()
    pairs = pairs.join(places(gold, "g"), [*key, "g"]).join(places(candidates, "c"), [*key, "c"]).select(*key, "c_at", "g_at")

    def fold(it):
        at, last, used, n_used = None, None, set(), 0
        for b in it:
            out = []
            for s, code, c, g in zip(*(x.to_pylist() for x in b.columns)):
                if (s, code) != at:
                    if at is not None:
                        out.append((*at, n_used))
                    at, last, used, n_used = (s, code), None, set(), 0
                if c != last and g not in used:
                    used.add(g)
                    last, n_used = c, n_used + 1
            yield _matched(out)
        if at is not None:
            yield _matched([(*at, n_used)])

    return pairs.repartition(*key).sortWithinPartitions(*key, "c_at", "g_at").mapInArrow(fold, "session_id string, code string, matched long")


def _matched(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["session_id", "code", "matched"])


def strict_counts(gold: DataFrame, candidates: DataFrame, n: int = 4) -> DataFrame:
    """Matched counts under first-fit matching, for `scores`."""
    plain = matched_counts(gold, candidates).drop("matched")
    return plain.join(strict_matches(gold, candidates, n), ["session_id", "code"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))


def stratified_sample(sessions: DataFrame, per_bucket: int, seed: str) -> DataFrame:
    """`per_bucket` sessions of each bucket, chosen by the hash of seed and id; the same for any partitioning."""
    place = F.md5(F.concat(F.lit(seed), "session_id"))
    w = Window.partitionBy("bucket").orderBy("place", "session_id")
    return sessions.withColumn("place", place).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_bucket).drop("place")


def integrity(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(problem, n): evidence whose turn is missing, or whose quote isn't in its turn."""
    j = evidence.join(turns.select("turn_id", F.col("text").alias("_text"), F.lit(True).alias("_there")), "turn_id", "left")
    problem = F.when(F.col("_there").isNull(), "missing_turn").when(F.coalesce(F.instr(F.col("_text"), F.col("quote")) == 0, F.lit(True)), "quote_not_in_turn")
    return j.select(problem.alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def totals_differ(totals: dict, tables: dict[str, DataFrame]) -> list[str]:
    """Names of the tables whose number of rows isn't the one stated in a manifest."""
    return [name for name, t in tables.items() if totals.get(name) != t.count()]


def assert_integrity(evidence: DataFrame, turns: DataFrame, totals: dict | None = None, tables: dict[str, DataFrame] | None = None) -> None:
    """An error if evidence points to no turn or quotes what isn't there, or if a manifest's totals don't hold."""
    faults = [f"{r['problem']}: {r['n']}" for r in integrity(evidence, turns).orderBy("problem").collect()]
    faults += [f"total of {name} differs" for name in (totals_differ(totals, tables or {}) if totals is not None else ())]
    if faults:
        raise ValueError("benchmark data are not whole: " + "; ".join(faults))


def mean_sd(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and sample deviation over runs; the deviation of one run is 0."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"))


def transport(passes: DataFrame, *by: str) -> DataFrame:
    """Share of passes that ended in an error, and that gave valid JSON."""
    n = F.count("*")
    rate = lambda c: F.round(ratio(F.sum(F.when(c, 1).otherwise(0)), n), 6)
    return passes.groupBy(*by).agg(n.alias("passes"), rate(F.col("status") == "error").alias("error_rate"), rate(F.col("valid_json")).alias("valid_json_rate"))


def outcomes(records: DataFrame) -> DataFrame:
    """Rework by cause: each real cause with its count and share, also those without records, and the top cause (`none` without rework; ties by name)."""
    spark = records.sparkSession
    causes = spark.createDataFrame([(c,) for c in C.REAL_CAUSES], "cause string")
    n = records.where("code = 'rework_cause'").groupBy("cause").agg(F.count("*").alias("n"))
    all_ = causes.join(F.broadcast(n), "cause", "left").select("cause", F.coalesce("n", F.lit(0)).alias("n"))
    total = all_.agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "cause")).alias("t"))
    return all_.join(F.broadcast(total), F.lit(True)).select("cause", "n", F.round(ratio(F.col("n"), F.col("total")), 6).alias("share"), F.when(F.col("total") > 0, F.col("t.cause")).otherwise("none").alias("top_cause"))


def deliveries(records: DataFrame) -> DataFrame:
    return records.where("code = 'delivery_result'").groupBy("delivery").agg(F.count("*").alias("n"))


def coverage(records: DataFrame) -> DataFrame:
    """Sessions with a record, by extractor."""
    return records.groupBy("extractor_version").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("n_records"))
