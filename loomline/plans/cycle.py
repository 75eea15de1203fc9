"""The mining cycle: new sessions to windows, passes, findings, ledger and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions import usage
from loomline.operators import normalize, prompts, register, reports, validate, windows
from loomline.operators.sensitivity import masked
from loomline.plans.model import Budget, Chat, call_model
from loomline.session import cut_lineage
from loomline.sources.store import TableStore

LEDGER = "window_id string, session_id string, family string, status string, created long, rejected long, error string, extractor_version string"
REGISTER = (
    "dedup_key string, record_id string, session_id string, window_id string, extractor_version string, family string, codebook_code string, unit string, statement string, actor string, source_reliability string, info_credibility int, "
    "confidence string, confidence_basis string, sensitivity string, evidence array<struct<turn_id:string,quote:string>>, facets string, assumptions string, alternatives string, disconfirming string, falsifiers string, quote_verified boolean, "
    "prompt_hash string, occurrences long, first_seen string, last_seen string, created_at string"
)
REJECTIONS = "window_id string, family string, position int, reason string, record string, extractor_version string"


@dataclass
class Summary:
    windows: int = 0
    passes: int = 0
    skipped: int = 0
    no_signal: int = 0
    created: int = 0
    rejected: int = 0
    errors: int = 0
    budget_exhausted: bool = False


def prepare(turns: DataFrame, limit: int = C.MAX_WINDOW_TOKENS, overlap: int = C.OVERLAP_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(windows, their turns with masked text)."""
    safe = turns.withColumn("shown", F.coalesce(masked(F.col("text"))["text"], F.lit("")))
    sized = cut_lineage(safe.withColumn("tokens", windows.token_estimate(F.col("shown"))).withColumn("flags", windows.family_flags(F.coalesce("text", F.lit("")))))
    wins = cut_lineage(windows.windows(sized, limit, overlap))
    return wins, windows.members(wins.drop("tokens", "flags"), sized)


def harness(store: TableStore, turns: DataFrame, chat: Chat, *, version: str, now: str, strategy: str = "per_family", limit: int = C.MAX_WINDOW_TOKENS, overlap: int = C.OVERLAP_TOKENS, budget: Budget | None = None, resume: bool = True, codebook: str = prompts.CODEBOOK, trace: str | None = None) -> Summary:
    """Run the passes of all windows that the ledger doesn't have, and store what comes of them.

    The work of a run is one batch, or as many as the call budget asks for. Failed passes are
    rows of the ledger, so a run that is begun again does only what is missing. Findings are
    counted by distinct record ids, so replaying a pass adds nothing. With `trace`, a table of that name gets a line of JSON for each pass.
    """
    wins, mem = prepare(turns, limit, overlap)
    plan = cut_lineage(windows.planned(wins, strategy))
    ledger = store.read("ledger", LEDGER)
    own = ledger.where(F.col("extractor_version") == version)
    todo = cut_lineage(windows.remaining(plan, own) if resume else plan)
    quiet = windows.no_signal(wins) if strategy == "per_family" else None
    out = Summary(windows=wins.count(), no_signal=0 if quiet is None else quiet.count(), skipped=plan.count() - todo.count())
    heads = prompts.heads(prompts.codebook(store.spark, codebook))
    budget = budget or Budget()
    while True:
        left = budget.left()
        batch = cut_lineage(todo if left is None else todo.orderBy("window_id", "family").limit(left))
        n = batch.count()
        if n == 0:
            out.budget_exhausted = left == 0 and not todo.isEmpty()
            break
        bundles = prompts.bundles(mem, batch, heads, text="shown").join(batch.select("window_id", "session_id", "window_index", "family"), ["session_id", "window_index", "family"])
        answers = cut_lineage(call_model(bundles, chat))
        wid = batch.select("window_id", "session_id", "window_index").distinct()
        surface = mem.join(wid, ["session_id", "window_index"]).select("window_id", "turn_id", "idx", "actor", "shown")
        judged = cut_lineage(validate.validated(answers.where("payload IS NOT NULL").select("window_id", "family", "payload"), surface))
        _store(store, answers, judged, version, now)
        if trace:
            told = judged.groupBy("window_id", "family").agg(F.collect_list(F.struct("position", "reason", "record")).alias("records"))  # at most a payload
            store.append_json(trace, bundles.select("window_id", "family", "prompt").join(answers.select("window_id", "family", "payload", "error", "attempts"), ["window_id", "family"]).join(told, ["window_id", "family"], "left"))
        got = judged.agg(F.count_if(F.col("reason").isNull()).alias("ok"), F.count_if(F.col("reason").isNotNull()).alias("bad")).first()
        spent = answers.agg(F.sum("attempts").alias("calls"), F.count("error").alias("errors")).first()
        budget.calls += spent["calls"] or 0
        costs = usage.costs(answers.where("usage IS NOT NULL").select(F.lit("model").alias("model"), usage.normalised(F.col("usage")).alias("u")).select("model", "u.*"))
        budget.usd += costs.agg(F.sum("effective_usd")).first()[0] or 0.0
        out.passes, out.created, out.rejected, out.errors = out.passes + n, out.created + got["ok"], out.rejected + got["bad"], out.errors + spent["errors"]
        if left is None:
            break
        todo = cut_lineage(todo.join(batch.select("window_id", "family"), ["window_id", "family"], "left_anti"))
    if quiet is not None:
        rows = quiet.select("window_id", "session_id", "family", "status", F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("rejected"), F.lit(None).cast("string").alias("error"), F.lit(version).alias("extractor_version"))
        store.write("ledger", cut_lineage(register.replace(store.read("ledger", LEDGER), rows, ["window_id", "extractor_version", "family"])))
    return out


def _store(store: TableStore, answers: DataFrame, judged: DataFrame, version: str, now: str) -> None:
    ok = judged.where("reason IS NULL").join(answers.select("window_id", "family", "session_id", "prompt_hash"), ["window_id", "family"])
    quotes = F.transform("resolved", lambda x: x["quote"])
    rid = F.concat(F.lit("cie_rec_"), F.substring(F.sha1(F.concat_ws(":", "window_id", "family", F.lit(version), "codebook_code", "statement", F.array_join(quotes, "|"))), 1, 20))
    evidence = F.transform("resolved", lambda x: F.struct(x["turn_id"].alias("turn_id"), x["quote"].alias("quote")))
    fresh = ok.select(
        register.dedup_key(F.col("codebook_code"), quotes, F.col("statement")).alias("dedup_key"), rid.alias("record_id"), "session_id", "window_id", F.lit(version).alias("extractor_version"), "family", "codebook_code", "unit", "statement",
        "actor", "source_reliability", "info_credibility", "confidence", "confidence_basis", F.when(F.col("sensitivity").isin(*C.SENSITIVITY_LEVELS), F.col("sensitivity")).otherwise("internal").alias("sensitivity"), evidence.alias("evidence"), "facets", "assumptions",
        F.col("alternative_interpretations").alias("alternatives"), F.col("disconfirming_evidence").alias("disconfirming"), "falsifiers", "quote_verified", "prompt_hash",
        F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"), F.lit(now).alias("created_at"),
    )
    seen = store.read("seen_records", "record_id string")
    new = cut_lineage(fresh.join(seen, "record_id", "left_anti"))
    store.write("register", cut_lineage(register.upsert(store.read("register", REGISTER), new)))
    store.write("seen_records", cut_lineage(seen.unionByName(new.select("record_id")).distinct()))
    rej = judged.where("reason IS NOT NULL").select("window_id", "family", F.coalesce("position", F.lit(0)).cast("int").alias("position"), "reason", "record", F.lit(version).alias("extractor_version"))
    keys = ["window_id", "extractor_version", "family"]
    done = answers.select("window_id", "family", F.lit(version).alias("extractor_version"))
    old = store.read("rejections", REJECTIONS).join(done, keys, "left_anti")
    store.write("rejections", cut_lineage(old.unionByName(rej)))
    n = judged.groupBy("window_id", "family").agg(F.count_if(F.col("reason").isNull()).alias("created"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    rows = answers.join(n, ["window_id", "family"], "left").select("window_id", "session_id", "family", F.when(F.col("error").isNull(), "processed").otherwise("error").alias("status"), F.coalesce("created", F.lit(0)).cast("long").alias("created"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"), "error", F.lit(version).alias("extractor_version"))
    store.write("ledger", cut_lineage(register.replace(store.read("ledger", LEDGER), rows, keys)))


def mine(store: TableStore, sessions: DataFrame, messages: DataFrame, chat: Chat, *, version: str, now: str, limit: int = 20, terms=C.EXCLUDE_TERMS, by_cursor: bool = True, report: str | None = None, **options) -> tuple[Summary, float | None]:
    """One cycle over a state store: sessions after the cursor, newest first.

    The cursor moves to the latest start only if the cycle was clean: no errors, budget not
    exhausted. With a limit, older sessions left out are then never seen again; `by_cursor=False`
    goes by what is stored instead, and loses none.
    """
    state = store.read("state", "key string, value string")
    row = state.where("key = 'last_started_at'").head()
    cursor = float(row["value"]) if row else None
    pool = sessions if by_cursor else sessions.join(store.read("ingested", "session_id string").withColumnRenamed("session_id", "id"), "id", "left_anti")
    chosen = cut_lineage(normalize.newest_sessions(pool, normalize.excluded_sessions(sessions, messages, terms), limit, cursor if by_cursor else None))
    ids = chosen.select(F.col("id").alias("session_id"))
    rows = messages.join(ids, "session_id", "left_semi").select("session_id", "id", "role", F.col("content").alias("text"), "tool_name", F.col("timestamp").alias("ts"))
    turns = cut_lineage(normalize.turns(normalize.positioned(rows)))
    summary = harness(store, turns, chat, version=version, now=now, **options)
    latest = chosen.agg(F.max("started_at")).first()[0]
    if latest is not None and summary.errors == 0 and not summary.budget_exhausted:
        cursor = max(latest, cursor or latest)
        fresh = store.spark.createDataFrame([("last_started_at", repr(cursor))], "key string, value string")
        store.write("state", cut_lineage(register.replace(state, fresh, ["key"])))
        done = store.read("ingested", "session_id string").unionByName(ids).distinct()
        store.write("ingested", cut_lineage(done))
    if report:
        store.write_text(report, findings_report(store))
    return summary, cursor


def findings_report(store: TableStore, k: int = 20) -> str:
    """The report of the register: totals and the first k verified findings of each family."""
    rows = store.read("register", REGISTER)
    t = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences")).first().asDict()
    return reports.findings_markdown(reports.top_findings(rows.where("quote_verified"), k), t)


def rekey(store: TableStore) -> dict:
    """Give the register new keys and merge what is the same; the version before stays as a backup. Occurrences must be conserved."""
    before = store.read("register", REGISTER)
    after = cut_lineage(register.rekeyed(before))
    r = register.conservation(before, after).first().asDict()
    if not (r["conserved"] or r["rows_before"] == 0):
        raise ValueError(f"occurrences are not conserved: {r}")
    return {**r, "version": store.write("register", after)}


def purge(store: TableStore) -> dict:
    """Remove findings whose first quote is a platform notice; what is removed and what is kept must add up."""
    before = store.read("register", REGISTER)
    kept, gone = register.purge(before)
    kept, gone = cut_lineage(kept), cut_lineage(gone)
    n = [d.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for d, c in ((before, "occurrences"), (kept, "occurrences"), (gone, "occurrences"))]
    if n[0] != n[1] + n[2]:
        raise ValueError(f"occurrences are not conserved: {n}")
    store.write("register", kept)
    return {r["notice"]: (r["n_rows"], r["occurrences"]) for r in gone.collect()}
