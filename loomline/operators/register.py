"""The findings register: identity, merging, purging, ledgers and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions.text import short_hash
from loomline.operators.validate import notice_id


def dedup_text(c: Column) -> Column:
    """Lower case, one line, no marks at the ends; null is empty."""
    one = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return F.regexp_replace(one, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def dedup_key(code: Column, quotes: Column, statement: Column) -> Column:
    """Identity of a finding by its evidence; `quotes` is an array in order.

    Several different quotes, one long enough: the set of quotes. A long first quote: that
    quote. Else the first quote guarded by the statement. The code is always part.
    """
    own = F.filter(F.transform(F.coalesce(quotes, F.array().cast("array<string>")), dedup_text), lambda q: q != "")
    uniq = F.array_sort(F.array_distinct(own))
    first = F.coalesce(F.try_element_at(own, F.lit(1)), F.lit(""))
    long = lambda q: F.length(q) >= C.MIN_PRIMARY_QUOTE_CHARS
    text = (
        F.when((F.size(uniq) >= 2) & F.exists(uniq, long), F.concat_ws("\u001f", F.lit("v2"), F.lit("quote_set"), dedup_text(code), F.array_join(uniq, "\u001e")))
        .when(long(first), F.concat_ws("\u001f", F.lit("v2"), F.lit("primary_quote"), dedup_text(code), first))
        .otherwise(F.concat_ws("\u001f", F.lit("v2"), F.lit("weak_quote_statement_guard"), dedup_text(code), first, dedup_text(statement)))
    )
    return F.concat(F.lit("cie_dedup_v2_"), short_hash(text, 32))


def evidence_quotes(evidence_json: Column) -> Column:
    """Quotes of an evidence list in order; none where it can't be read."""
    return F.coalesce(F.from_json(evidence_json, "array<struct<quote:string>>")["quote"], F.array().cast("array<string>"))


def merge(rows: DataFrame) -> DataFrame:
    """One row a key of (dedup_key, record_id, statement, occurrences, first_seen, last_seen, created_at).

    The kept record has the longest statement, then the latest time, then the largest id.
    Counts add up, times widen; empty strings count as missing. Everything is combined
    before the shuffle, so a hot key costs no more than others.
    """
    seen = lambda c: F.when(F.col(c) != "", F.col(c))
    rank = F.struct(F.length(F.coalesce("statement", F.lit(""))).alias("n"), F.coalesce(seen("last_seen"), seen("created_at"), F.lit("")).alias("t"), F.coalesce("record_id", F.lit("")).alias("r"), "statement")
    return rows.groupBy("dedup_key").agg(
        F.max(rank).alias("k"), F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("occurrences"), F.min(seen("first_seen")).alias("first_seen"), F.max(seen("last_seen")).alias("last_seen"), F.count("*").alias("n_rows"),
    ).select("dedup_key", F.col("k.r").alias("record_id"), F.col("k.statement").alias("statement"), "occurrences", "first_seen", "last_seen", "n_rows")


def upsert(register: DataFrame, fresh: DataFrame) -> DataFrame:
    """Register with new records merged in; every column of the register is kept, from the first record of its key.

    A known record id is no new occurrence, so replaying a batch changes nothing; new ids of
    a known key add their number to it. `fresh` counts one for each distinct id; columns it lacks are null.
    """
    unknown = fresh.dropDuplicates(["record_id"]).join(register.select("record_id"), "record_id", "left_anti").withColumn("occurrences", F.lit(1).cast("long"))
    both = register.withColumn("_old", F.lit(True)).unionByName(unknown.withColumn("_old", F.lit(False)).select("_old", *[c for c in register.columns if c in unknown.columns]), allowMissingColumns=True)
    settled = ("occurrences", "first_seen", "last_seen")
    rest = [c for c in register.columns if c not in ("dedup_key", "created_at", "record_id", *settled)]
    first = F.min(F.struct((~F.col("_old")).alias("_o"), "created_at", "record_id", *rest))
    got = both.groupBy("dedup_key").agg(first.alias("k"), F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return got.select(*[F.col(c) if c in ("dedup_key", *settled) else F.col(f"k.{c}").alias(c) for c in register.columns])


def rekeyed(register: DataFrame) -> DataFrame:
    """The stored register under newly made keys: rows whose evidence is the same are one, with all columns of the kept one."""
    key = dedup_key(F.col("codebook_code"), F.col("evidence")["quote"], F.col("statement"))
    rows = register.withColumn("dedup_key", key)
    kept = merge(rows)
    rest = [c for c in register.columns if c not in ("dedup_key", "record_id", "statement", "occurrences", "first_seen", "last_seen")]
    whole = kept.drop("n_rows").join(rows.select("record_id", *rest).dropDuplicates(["record_id"]), "record_id")
    return whole.select(*register.columns)


def conservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and occurrences before and after a merge; `conserved` must be true."""
    a = before.agg(F.count("*").alias("rows_before"), F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("occurrences_before"))
    b = after.agg(F.count("*").alias("rows_after"), F.sum("occurrences").cast("long").alias("occurrences_after"))
    return a.join(b, F.lit(True)).withColumn("conserved", F.col("occurrences_before").eqNullSafe(F.col("occurrences_after")))


def purge(rows: DataFrame, first_quote: str = "first_quote") -> tuple[DataFrame, DataFrame]:
    """(kept rows, removals by notice): rows whose first quote (a column, or that of `evidence`) is a platform notice are removed."""
    marked = rows.withColumn("notice", notice_id(F.col(first_quote) if first_quote in rows.columns else F.try_element_at("evidence", F.lit(1))["quote"]))
    gone = marked.where("notice IS NOT NULL").groupBy("notice").agg(F.count("*").alias("n_rows"), F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("occurrences"))
    return marked.where("notice IS NULL").drop("notice"), gone


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, larger is later: upserts, last write wins."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("k")).select(*keys, *[F.col(f"k.{c}").alias(c) for c in rest])


def replace(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of the keys in `fresh` replaced."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def errored(ledger: DataFrame, version: str | None = None) -> DataFrame:
    rows = ledger.where("status = 'error'")
    return (rows if version is None else rows.where(F.col("extractor_version") == version)).orderBy("session_id", "window_id", "family")


def progress(ledger: DataFrame) -> DataFrame:
    """(family, status, runs, created, rejected, sessions)."""
    return ledger.groupBy("family", "status").agg(
        F.count("*").alias("runs"), F.sum(F.coalesce("created", F.lit(0))).cast("long").alias("created"), F.sum(F.coalesce("rejected", F.lit(0))).cast("long").alias("rejected"), F.countDistinct("session_id").alias("sessions")
    )


def enqueued(sessions: DataFrame, queue: DataFrame | None, version: str, streams=C.STREAMS) -> DataFrame:
    """Work items that are missing: each session once a stream. The streams are a fixed list, exploded, not joined."""
    want = sessions.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.lit(s) for s in streams])).alias("stream"), F.lit(version).alias("extractor_version"), F.lit("pending").alias("status"))
    return want if queue is None else want.join(queue.select("session_id", "stream", "extractor_version"), ["session_id", "stream", "extractor_version"], "left_anti")


def reset_stale(queue: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Running items begun more than `minutes` before `now` are pending again."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(mins=F.lit(minutes)))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("started_at", F.when(stale, None).otherwise(F.col("started_at")))


def retry_failed(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def completed(queue: DataFrame, sessions: DataFrame, version: str) -> DataFrame:
    """Work items with those of the sessions and the version completed."""
    done = sessions.select("session_id").distinct().withColumn("_done", F.lit(True))
    return queue.join(done, "session_id", "left").withColumn("status", F.when(F.col("_done") & (F.col("extractor_version") == version), "completed").otherwise(F.col("status"))).drop("_done").select(*queue.columns)


def approved(approvals: DataFrame, key: str = "pilot_approved") -> bool:
    """Whether the gate is open; a missing row is closed."""
    row = approvals.where(F.col("key") == key).select("value").head()
    return bool(row) and str(row[0]).lower() in ("true", "1", "yes")
