"""Transcript files, benchmark folders, state stores, and table sinks."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.operators.normalize import first_field, message_text
from loomline.operators.scan import running_total

#: Keys under which a JSON transcript may keep its messages, in order of preference.
LIST_KEYS = ("messages", "conversation", "turns")
SUFFIXES = ("json", "jsonl")


def files(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(path, suffix, content, content_hash, session_id) of every file below `path`.

    The session id comes from the content, so a file ingested again is the same session.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if exclude:
        raw = raw.where(~F.lower("path").contains(exclude.lower()))
    digest = F.sha2("content", 256)
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.decode("content", "UTF-8").alias("content"), digest.alias("content_hash"), F.concat(F.lit("file:"), F.substring(digest, 1, 16)).alias("session_id"))


def unseen(found: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files whose content isn't stored without error yet."""
    done = sessions.where("status <> 'error'").select("session_id", "content_hash")
    return found.join(done, ["session_id", "content_hash"], "left_anti")


def parsed(found: DataFrame) -> DataFrame:
    """(session_id, path, content_hash, idx, message, bad): one row a message, as JSON text.

    A .jsonl file has a message a line, blank lines aside; a .json file holds a list, or
    an object with one under `LIST_KEYS`. `bad` says why a file can't be used: any
    unreadable line spoils its file, named with its number.
    """
    keep = ["session_id", "path", "content_hash"]
    lines = found.where("suffix = 'jsonl'").select(*keep, F.posexplode(F.split("content", r"\r?\n")).alias("line", "message")).where("trim(message) <> ''")
    bad_line = F.when(F.try_parse_json("message").isNull(), F.concat(F.lit("unreadable line "), (F.col("line") + 1).cast("string")))
    lines = lines.select(*keep, F.col("line").cast("long").alias("line"), "message", bad_line.alias("bad"))
    v = F.try_parse_json("content")
    is_list = lambda x: F.coalesce(F.schema_of_variant(x).startswith("ARRAY"), F.lit(False))
    picked = reduce(lambda rest, k: F.when(is_list(F.try_variant_get(v, f"$.{k}", "variant")), F.to_json(F.try_variant_get(v, f"$.{k}", "variant"))).otherwise(rest), reversed(LIST_KEYS), F.lit(None).cast("string"))
    listed = F.when(is_list(v), F.to_json(v)).otherwise(picked)
    docs = found.where("suffix = 'json'").select(*keep, listed.alias("list"))
    messages = docs.select(*keep, F.posexplode_outer(F.from_json("list", "array<string>")).alias("line", "message"), F.when(F.col("list").isNull(), "no list of messages").alias("bad")).where("bad IS NOT NULL OR message IS NOT NULL")
    other = found.where(~F.col("suffix").isin(*SUFFIXES)).select(*keep, F.lit(0).cast("long").alias("line"), F.lit(None).cast("string").alias("message"), F.concat(F.lit("unsupported file type: "), "suffix").alias("bad"))
    return lines.unionByName(messages.select(*keep, F.col("line").cast("long").alias("line"), "message", "bad")).unionByName(other)


def sessions_of(rows: DataFrame) -> DataFrame:
    """(session_id, path, content_hash, status, error_detail) of parsed files."""
    return rows.groupBy("session_id", "path", "content_hash").agg(F.min("bad").alias("error_detail")).withColumn("status", F.when(F.col("error_detail").isNull(), "normalized").otherwise("error"))


def messages_of(rows: DataFrame) -> DataFrame:
    """(session_id, idx, role, text, tool_name, ts) of files without errors; fields have several names, of which the first that says something counts.

    `idx` is the message's place in the file among messages, blank lines aside.
    """
    ok = rows.join(rows.where("bad IS NOT NULL").select("session_id").distinct(), "session_id", "left_anti")
    ids = ok.select("session_id", "line", F.lit(1).alias("_one"))
    placed = ok.select("session_id", "line", "message").join(running_total(ids, "session_id", "line", "_one", "idx"), ["session_id", "line"])
    get = lambda k: F.get_json_object("message", f"$.{k}")
    is_object = F.trim("message").startswith("{")
    content = F.to_json(F.try_variant_get(F.try_parse_json("message"), "$.content", "variant"))
    return placed.select(
        "session_id", F.col("idx").cast("int").alias("idx"), F.when(is_object, F.coalesce(first_field(get("role"), get("actor"), get("type")), F.lit("unknown"))).otherwise("unknown").alias("role"),
        F.when(is_object, message_text(content)).otherwise(F.col("message")).alias("text"), first_field(get("tool_name"), get("name")).alias("tool_name"), first_field(get("timestamp"), get("ts")).alias("ts"),
    )


def state_store(sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages of an agent's state store, whatever optional columns it has: `cwd` may be missing, and inactive messages are left out where there is a column `active`.

    Give DataFrames from Parquet, or from `spark.read.format("jdbc")` where a driver is at hand; filters on them are pushed down.
    """
    s = sessions if "cwd" in sessions.columns else sessions.withColumn("cwd", F.lit(""))
    m = messages.where("active = 1") if "active" in messages.columns else messages
    return s.where("message_count > 0"), m


def benchmark(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A benchmark folder (manifest.json, sessions, gold, baseline) as DataFrames.

    A session's bucket is that of the manifest, else its own.
    """
    read = lambda p: spark.read.option("multiLine", True).json(f"{path}/{p}")
    manifest, sessions = read("manifest.json"), read("sessions")
    entries = manifest.select(F.explode("entries").alias("e")).select("e.session_id", F.col("e.bucket").alias("_b"))
    own = F.col("bucket") if "bucket" in sessions.columns else F.lit(None).cast("string")
    heads = sessions.withColumn("_own", own).join(F.broadcast(entries), "session_id", "left").select("session_id", F.coalesce("_b", "_own").alias("bucket"))
    told = sessions.select(F.col("session_id").alias("_s"), F.explode("turns").alias("t")).select("_s", "t.*")
    own_columns = {"turn_id": "string", "idx": "int", "actor": "string", "text": "string", "tool_name": "string"}
    # a member that is null or missing everywhere has no column; turns belong to the session of their file
    turns = told.select(F.col("_s").alias("session_id"), *[(F.col(c) if c in told.columns else F.lit(None)).cast(t).alias(c) for c, t in own_columns.items()])

    def side(name: str) -> DataFrame:
        r = read(name).select("session_id", F.posexplode("records").alias("ord", "r"))
        return r.select("session_id", "ord", F.col("r.codebook_code").alias("code"), F.try_element_at("r.evidence", F.lit(1))["quote"].alias("quote"), F.col("r.evidence").alias("evidence")).where("code <> ''")

    return {"manifest": manifest, "sessions": heads, "turns": turns, "gold": side("gold"), "baseline": side("baseline")}


def freeze(sessions: DataFrame, turns: DataFrame, gold: DataFrame, baseline: DataFrame, path: str, *, codebook: str | None = None, window_params: tuple[int, int] = (C.MAX_WINDOW_TOKENS, C.OVERLAP_TOKENS), sampling: str = "all") -> DataFrame:
    """Write a benchmark folder (one JSON document a session) and return its totals as one row.

    A frozen set is a small sample; each session's turns fit one document.
    """
    whole = turns.join(sessions.select("session_id", "bucket"), "session_id").groupBy("session_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("idx", "turn_id", "actor", "text", "tool_name"))).alias("turns"))
    whole.write.mode("overwrite").json(f"{path}/sessions")
    for name, side in (("gold", gold), ("baseline", baseline)):
        side.join(sessions.select("session_id"), "session_id").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("code").alias("codebook_code"), "evidence"))).alias("records")).write.mode("overwrite").json(f"{path}/{name}")
    n = lambda d, a: d.join(sessions.select("session_id"), "session_id", "left_semi").agg(F.count("*").alias(a))
    totals = sessions.agg(F.count("*").alias("sessions")).join(n(turns, "turns"), F.lit(True)).join(n(gold, "gold_findings"), F.lit(True)).join(n(baseline, "baseline_findings"), F.lit(True))
    buckets = sessions.groupBy().agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("short", "medium", "long")])
    entries = sessions.select(F.struct("session_id", "bucket").alias("e")).agg(F.sort_array(F.collect_list("e")).alias("entries"))
    digest = None
    if codebook is not None:
        with open(codebook, "rb") as f:
            digest = hashlib.sha256(f.read()).hexdigest()[:16]
    head = totals.select(
        F.struct("*").alias("totals"), F.lit(sampling).alias("sampling"), F.lit(digest).alias("codebook_sha256_16"), F.struct(F.lit(window_params[0]).alias("max_window_tokens"), F.lit(window_params[1]).alias("overlap_tokens")).alias("window_params"),
    )
    head.join(buckets.select(F.struct("*").alias("buckets")), F.lit(True)).join(entries, F.lit(True)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")
    return totals
