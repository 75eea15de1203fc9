"""Incremental ingest of transcript files by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators import normalize
from loomline.session import cut_lineage
from loomline.sources import transcripts
from loomline.sources.store import TableStore

TURNS = "turn_id string, session_id string, idx int, actor string, ts string, text string, tool_name string"
SESSIONS = "session_id string, path string, content_hash string, error_detail string, status string, turn_count long"


def stream(spark: SparkSession, inbox: str) -> DataFrame:
    """New files of a folder as rows of `transcripts.files`."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(inbox)
    digest = F.sha2("content", 256)
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.decode("content", "UTF-8").alias("content"), digest.alias("content_hash"), F.concat(F.lit("file:"), F.substring(digest, 1, 16)).alias("session_id"))


def take_in(store: TableStore, batch: DataFrame) -> None:
    """One batch of files into the tables `sessions` and `turns`; the same batch again changes nothing."""
    sessions = store.read("sessions", SESSIONS)
    fresh = cut_lineage(transcripts.unseen(batch, sessions).dropDuplicates(["session_id"]))
    if fresh.isEmpty():
        return
    rows = cut_lineage(transcripts.parsed(fresh))
    turns = cut_lineage(normalize.turns(transcripts.messages_of(rows)))
    store.write("turns", cut_lineage(normalize.replace_sessions(store.read("turns", TURNS), turns)))
    n = turns.groupBy("session_id").agg(F.count("*").alias("turn_count"))
    taken = transcripts.sessions_of(rows).join(n, "session_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)).cast("long"))
    store.write("sessions", cut_lineage(normalize.replace_sessions(sessions, taken.select(*sessions.columns))))


def take_state(store: TableStore, sessions: DataFrame, messages: DataFrame, limit: int = 20) -> int:
    """The newest sessions of a state store into the tables, unless their content is stored already; returns how many changed."""
    chosen = cut_lineage(normalize.newest_sessions(sessions, normalize.excluded_sessions(sessions, messages), limit).select(F.col("id").alias("session_id")))
    rows = messages.join(chosen, "session_id", "left_semi").select("session_id", "id", "role", F.col("content").alias("text"), "tool_name", F.col("timestamp").cast("string").alias("ts"))
    turns = cut_lineage(normalize.turns(normalize.positioned(rows)))
    stored = store.read("sessions", SESSIONS)
    hashes = normalize.content_hashes(turns)
    changed = cut_lineage(normalize.changed_sessions(hashes, stored).select("session_id", "content_hash"))
    fresh = turns.join(changed, "session_id", "left_semi")
    n = fresh.groupBy("session_id").agg(F.count("*").alias("turn_count"))
    taken = changed.join(n, "session_id").select("session_id", F.lit("state").alias("path"), "content_hash", F.lit(None).cast("string").alias("error_detail"), F.lit("normalized").alias("status"), "turn_count")
    store.write("turns", cut_lineage(normalize.replace_sessions(store.read("turns", TURNS), fresh)))
    store.write("sessions", cut_lineage(normalize.replace_sessions(stored, taken.select(*stored.columns))))
    return changed.count()


def start(store: TableStore, inbox: str, checkpoint: str) -> StreamingQuery:
    """Take in what is there and stop; files and offsets live in the checkpoint, tables in the store."""
    return stream(store.spark, inbox).writeStream.foreachBatch(lambda b, _: take_in(store, b)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
