"""The rule-based extraction over stored turns: gate, queue, records, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline import constants as C
from loomline.operators import register, signals
from loomline.session import cut_lineage
from loomline.sources.store import TableStore

RECORDS = (
    "record_id string, session_id string, stream string, pattern_type string, summary string, evidence array<struct<turn_id:string,char_start:int,char_end:int,quote:string>>, scope string, actor string, confidence double, sensitivity string, "
    "verification_status string, extractor string, extractor_version string, recommended_sink string"
)
QUEUE = "session_id string, stream string, extractor_version string, status string, started_at timestamp, last_error string"
APPROVALS = "key string, value string, approved_by string, approved_at string, notes string"
SESSIONS = "session_id string, path string, content_hash string, error_detail string, status string, turn_count long"
TURNS = "turn_id string, session_id string, idx int, actor string, ts string, text string, tool_name string"


class NotApproved(RuntimeError):
    """Extraction over the whole corpus without an approved pilot."""


def approve(store: TableStore, by: str, notes: str, now: str) -> None:
    """Open the gate for the whole corpus."""
    fresh = store.spark.createDataFrame([("pilot_approved", "true", by, now, notes)], APPROVALS)
    store.write("approvals", cut_lineage(register.replace(store.read("approvals", APPROVALS), fresh, ["key"])))


def run(store: TableStore, *, full_corpus: bool = False, stale_minutes: int = 30, now=None) -> dict:
    """Reset stale work, enqueue what is missing, and extract from the sessions that are normalised; these are then `extracted`
    and their work is completed. `full_corpus` needs an approved pilot."""
    if full_corpus and not register.approved(store.read("approvals", APPROVALS)):
        raise NotApproved("the whole corpus needs an approved pilot")
    now = F.current_timestamp() if now is None else now
    sessions = store.read("sessions", SESSIONS)
    todo = cut_lineage(sessions.where("status = 'normalized'").select("session_id"))
    queue = register.reset_stale(store.read("work_items", QUEUE), now, stale_minutes)
    fresh = cut_lineage(register.enqueued(sessions.where("status <> 'error'"), queue, C.DETERMINISTIC_VERSION))
    queue = queue.unionByName(fresh, allowMissingColumns=True)
    stored = store.read("records", RECORDS)
    turns = store.read("turns", TURNS).join(todo, "session_id", "left_semi")
    records = cut_lineage(signals.records(signals.capped(signals.candidates(turns)), stored).withColumn("confidence", F.col("confidence").cast("double")))
    store.write("records", stored.unionByName(records))
    store.write("work_items", cut_lineage(register.completed(queue, todo, C.DETERMINISTIC_VERSION)))
    done = todo.withColumn("_done", F.lit(True))
    store.write("sessions", cut_lineage(sessions.join(done, "session_id", "left").withColumn("status", F.when(F.col("_done"), "extracted").otherwise(F.col("status"))).select(*sessions.columns)))
    return {"queued": fresh.count(), "sessions": todo.count(), "records_created": records.count()}


def retry_failed(store: TableStore) -> None:
    store.write("work_items", cut_lineage(register.retry_failed(store.read("work_items", QUEUE))))


def status(store: TableStore) -> dict:
    """Counts of the store and the state of the gate."""
    n = lambda name, schema: store.read(name, schema).count()
    work = {r["status"]: r["n"] for r in register.status_counts(store.read("work_items", QUEUE)).withColumnRenamed("count", "n").collect()}
    return {"sessions": n("sessions", SESSIONS), "turns": n("turns", TURNS), "records": n("records", RECORDS), "work_items": work, "pilot_approved": register.approved(store.read("approvals", APPROVALS))}
