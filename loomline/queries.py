"""Queries over the domain tables, one for each operator, and the same in SQL.

Tables hold re-delivered rows, so each query first takes every row once. Where the
tables have no counterpart (model payloads, provider usage, ledgers), columns are
derived from them by arithmetic that Spark and SQL write alike; such inputs are
scaffolding and say nothing about the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions import usage
from loomline.functions.text import brief, cut_at_word, non_empty, strip
from loomline.operators import normalize, prompts, register, reports, scan, scoring, sensitivity, signals, validate, windows
from loomline.session import cut_lineage, table
from loomline.sources import transcripts

LIMIT, OVERLAP = 300, 60
TERMS = (*C.EXCLUDE_TERMS, "nightly cycle", "basalt-switch")


# --- inputs ---------------------------------------------------------------------


def _turns(spark: SparkSession, root: str) -> DataFrame:
    """Turns, each once."""
    return table(spark, root, "turns").dropDuplicates(["turn_id"])


def _messages(spark: SparkSession, root: str) -> DataFrame:
    """Messages of sessions, each once, with their position by arrival."""
    m = table(spark, root, "messages").where("session_id IS NOT NULL AND id IS NOT NULL")
    return normalize.positioned(m.select("session_id", "id", "role", F.col("content").alias("text"), "tool_name", F.col("timestamp").alias("ts")))


def _records(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "records").dropDuplicates(["record_id"])


def _flagged(spark: SparkSession, root: str) -> DataFrame:
    """Turns with masked text, its tokens and the families of the text itself, as in `plans.cycle.prepare`."""
    t = _turns(spark, root).withColumn("shown", F.coalesce(sensitivity.masked(F.col("text"))["text"], F.lit("")))
    return t.withColumn("tokens", windows.token_estimate(F.col("shown"))).withColumn("flags", windows.family_flags(F.coalesce("text", F.lit(""))))


def _windows(spark: SparkSession, root: str) -> DataFrame:
    return windows.windows(_flagged(spark, root), LIMIT, OVERLAP)


# --- normalisation -----------------------------------------------------------------


def turns_normalized(spark, root):
    t = normalize.turns(_messages(spark, root))
    return t.select("turn_id", "session_id", "idx", "actor", "tool_name", F.length("text").cast("long").alias("n_chars"))


def turn_offsets(spark, root):
    return normalize.with_offsets(_turns(spark, root).select("turn_id", "session_id", "idx", "text")).select("turn_id", "char_start", "char_end")


def actor_turn_counts(spark, root):
    m = table(spark, root, "messages").where("session_id IS NOT NULL").dropDuplicates(["session_id", "id"])
    return m.groupBy(normalize.actor(F.lower(strip(F.coalesce("role", F.lit(""))))).alias("actor")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("content", F.lit("")))).cast("long").alias("n_chars"))


def skip_rule_counts(spark, root):
    m = table(spark, root, "messages").where("session_id IS NOT NULL").dropDuplicates(["session_id", "id"])
    rules = normalize.skip_rules(F.lower(strip(F.coalesce("role", F.lit("")))), F.col("tool_name"), F.col("content"))
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("hit")) for k, v in rules.items()])).alias("r"))
    return rows.groupBy("r.rule").agg(F.sum(F.col("r.hit").cast("int")).cast("long").alias("n"))


def exclude_feedback_sessions(spark, root):
    return normalize.excluded_sessions(table(spark, root, "sessions"), table(spark, root, "messages"), TERMS)


def newest_n_sessions(spark, root):
    s = table(spark, root, "sessions")
    return normalize.newest_sessions(s, normalize.excluded_sessions(s, table(spark, root, "messages"), TERMS), 20, 1_740_000_000.0).select("id", "started_at", "message_count")


def content_hash_changes(spark, root):
    t = _turns(spark, root).select("session_id", "idx", "actor", "tool_name", "text")
    edited = t.withColumn("text", F.when((F.col("idx") % 97) == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return normalize.changed_sessions(normalize.content_hashes(edited), normalize.content_hashes(t))


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Transcript files made from blocks of 64 messages, in every form the readers know; some hold a bad line, some have another suffix."""
    m = _messages(spark, root).select(F.concat_ws(":", "session_id", F.floor(F.col("idx") / 64).cast("string")).alias("session_id"), "idx", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(non_empty(F.col("text")), F.lit("x")).alias("text"), F.coalesce("tool_name", F.lit("")).alias("tool"))
    tail, i = F.lit("tail"), F.col("idx") % 4
    line = (
        F.when(i == 0, F.to_json(F.struct("role", F.col("text").alias("content"), F.col("tool").alias("tool_name"))))
        .when(i == 1, F.concat(F.lit("{"), F.expr("substring(to_json(struct(role AS actor, tool AS name)), 2, length(to_json(struct(role AS actor, tool AS name))) - 2)"), F.lit(',"content":['), F.to_json(F.struct("text")), F.lit(',"tail"]}')))
        .when(i == 2, F.to_json(F.struct(F.col("role").alias("type"), F.array("text", tail).alias("content"), F.lit("t").alias("ts"))))
        .otherwise(F.to_json(F.struct(F.lit("").alias("role"), F.col("role").alias("actor"), F.array(F.struct(F.col("text").alias("content")), F.struct(tail.alias("content"))).alias("content"))))
    )
    rows = m.select("session_id", "idx", line.alias("line")).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]).alias("l"))
    digit = F.conv(F.substring(F.md5("session_id"), 1, 1), 16, 10).cast("int")
    suffix = F.when(digit == 0, "txt").when(digit < 8, "jsonl").otherwise("json")
    listed = F.concat(F.lit("["), F.array_join("l", ","), F.lit("]"))
    content = (
        F.when(digit == 7, F.concat(F.array_join("l", "\n"), F.lit("\n\n{broken"))).when(digit < 7, F.array_join("l", "\n\n")).when(digit == 8, listed).when(digit == 15, F.lit('{"messages": 5}'))
        .otherwise(F.concat(F.lit('{"'), _pick(transcripts.LIST_KEYS, digit), F.lit('": '), listed, F.lit("}")))
    )
    return rows.select(F.concat("session_id", F.lit("."), suffix).alias("path"), suffix.alias("suffix"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), "session_id")


def transcript_files(spark, root):
    """Status of each transcript file."""
    return transcripts.sessions_of(transcripts.parsed(_files(spark, root))).select("path", "status", F.col("error_detail").isNotNull().alias("told"))


def transcript_messages(spark, root):
    """Messages of the files without a fault, whatever the names of their fields."""
    return transcripts.messages_of(cut_lineage(transcripts.parsed(_files(spark, root)))).select("session_id", "idx", "role", "text", "tool_name", "ts")


def replaced_sessions(spark, root):
    """Turns after a sixteenth of the sessions came again with their first turns only."""
    t = _turns(spark, root).select("turn_id", "session_id", "idx")
    return normalize.replace_sessions(t, t.where((F.substring(F.md5("session_id"), 1, 1) == "0") & (F.col("idx") < 5))).groupBy("session_id").agg(F.count("*").alias("n"))


# --- windows -------------------------------------------------------------------------


def token_estimate(spark, root):
    return _flagged(spark, root).groupBy("session_id").agg(F.count("*").alias("n_turns"), F.sum("tokens").cast("long").alias("tokens"), F.max("tokens").alias("largest"))


def session_windows(spark, root):
    """The flagship: overlapping windows of each session."""
    return _windows(spark, root).drop("flags")


def window_ids(spark, root):
    return _windows(spark, root).select(windows.window_id().alias("window_id"), "session_id", "window_index")


def window_overlap_turns(spark, root):
    t = _turns(spark, root).select("session_id", "idx", "turn_id")
    m = windows.members(_windows(spark, root).drop("tokens", "flags"), t)
    return m.groupBy("turn_id").agg(F.count("*").alias("n_windows")).where("n_windows > 1")


def family_routing(spark, root):
    w = _windows(spark, root)
    return w.select("session_id", "window_index", F.concat_ws(",", windows.routed(F.col("flags"))).alias("families"))


def no_signal_windows(spark, root):
    return windows.no_signal(_windows(spark, root)).select("window_id", "session_id", "status")


def planned_prompts(spark, root):
    w = cut_lineage(_windows(spark, root))
    plans = [windows.planned(w, s).groupBy("family").agg(F.count("*").alias("n")).withColumn("strategy", F.lit(s)) for s in ("per_family", "combined")]
    return plans[0].unionByName(plans[1]).select("strategy", "family", "n")


def resume_remaining(spark, root):
    plan = windows.planned(cut_lineage(_windows(spark, root)))
    status = F.element_at(F.array(F.lit("processed"), F.lit("error"), F.lit("no_signal")), (F.conv(F.substring("window_id", 9, 4), 16, 10).cast("int") % 3) + 1)
    return windows.remaining(plan, plan.select("window_id", "family", status.alias("status"))).select("window_id", "family")


def prompt_clip_tier(spark, root):
    t = _flagged(spark, root).withColumn("flags", F.lit(0))  # the families aren't asked for
    m = windows.members(windows.windows(t, LIMIT, OVERLAP).drop("tokens", "flags"), t.select("session_id", "idx", "turn_id", "actor", "tool_name", "shown"))
    sizes = prompts.tiers(m, "shown", chars=(200, 90, 42))
    return sizes.select("session_id", "window_index", "n1", "n2", "n3", prompts.clip_tier(F.col("n1"), F.col("n2"), F.lit(400), 300).alias("tier"))


def prompt_examples(spark, root):
    """Examples of each pass, in order, from the codebook."""
    book = prompts.codebook(spark)
    return prompts.few_shots(book["few_shots"], book["passes"]).select("family", "place", "ord")


def pass_cards(spark, root):
    """Codes of each pass with the parts of their cards."""
    book = prompts.codebook(spark)
    n = lambda k: F.json_array_length(F.get_json_object("card", f"$.{k}")).alias(k)
    return prompts.code_cards(book["codes"], book["passes"]).select("family", F.get_json_object("card", "$.code").alias("code"), n("includes"), n("excludes"))


# --- sensitivity ---------------------------------------------------------------------------


def sensitivity_level(spark, root):
    return table(spark, root, "documents").select("doc_id", sensitivity.quick_level(F.col("text")).alias("level"))


def secret_hit_counts(spark, root):
    counts = sensitivity.hit_counts(F.col("text"))
    return table(spark, root, "documents").select("doc_id", *[n.cast("int").alias(f"n_{k}") for k, n in counts.items()])


def masked_text(spark, root):
    return table(spark, root, "documents").withColumn("m", sensitivity.masked(F.col("text"))).select("doc_id", F.col("m.text").alias("text"), F.col("m.level").alias("level"), F.col("m.n_hits").alias("n_hits"))


# --- signals ----------------------------------------------------------------------------------


def question_signals(spark, root):
    return _turns(spark, root).where(F.col("actor").isin("user", "agent") & signals.is_question(F.col("text"))).select("turn_id", "actor")


def correction_signals(spark, root):
    t = _turns(spark, root).where((F.col("actor") == "user") & signals.is_correction(F.col("text")))
    return t.select("turn_id", F.when(signals.limits_authority(F.col("text")), "authorization_limit").otherwise("correction").alias("pattern_type"))


def tool_failures(spark, root):
    return _turns(spark, root).where((F.col("actor") == "tool") & F.col("tool_name").isin("terminal", "process") & signals.is_tool_failure(F.col("text"))).select("turn_id")


def methodology_signals(spark, root):
    return _turns(spark, root).where((F.col("actor") == "agent") & signals.is_method(F.col("text"))).select("turn_id")


def methodology_sinks(spark, root):
    t = _turns(spark, root).where((F.col("actor") == "agent") & signals.is_method(F.col("text")))
    return t.groupBy(signals.method_sink(F.col("text")).alias("sink")).agg(F.count("*").alias("n"))


def brief_text(spark, root):
    return _turns(spark, root).select("turn_id", brief(F.col("text"), C.BRIEF_CHARS).alias("brief"))


def evidence_quote(spark, root):
    return table(spark, root, "documents").select("doc_id", cut_at_word(strip(F.col("text")), C.QUOTE_CHARS).alias("quote"))


def signal_caps(spark, root):
    """Hits within the caps, by session, stream and cap key."""
    hits = signals.capped(signals.candidates(_turns(spark, root)))
    return hits.groupBy("session_id", F.col("hit.stream").alias("stream"), F.col("hit.cap_key").alias("cap_key")).agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"))


def signal_records(spark, root):
    r = signals.records(signals.capped(signals.candidates(_turns(spark, root))))
    return r.select("record_id", "session_id", "stream", "pattern_type", "summary", "actor", F.col("confidence").cast("double").alias("confidence"), "sensitivity", "recommended_sink")


# --- validation -----------------------------------------------------------------------------------


def _pick(values, n) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)) + 1)


_CRED = ("3", '"4"', "2.7", "9", '"x"', "1", "6", "true")
_CONFIDENCE = ("0.9", '"0.9"', "0.5", '"High"', "null", "true", "[1]")
_NOTICES = (*C.NOTICE_EXACT.values(), "Foreground timeout 900s exceeds the maximum of 600s. Use background=true with notify_on_complete=true for long-running commands.")


def _payloads(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, surface): JSON answers about blocks of 64 turns, one record a turn, with faults by position; a turn in 37 is a platform notice."""
    i = F.col("idx")
    text = F.when(i % 37 == 0, _pick(_NOTICES, F.floor(i / 37).cast("int"))).otherwise(F.coalesce("text", F.lit("")))
    t = _turns(spark, root).select("turn_id", "session_id", "idx", "actor", F.concat_ws(":", "session_id", F.floor(i / 64).cast("string")).alias("window_id"), text.alias("shown"))
    js = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    code, family = _pick((*C.ALL_CODES, "other"), i), F.lit("methodology_workflow")
    for fam, own in C.PASS_CODES.items():
        family = F.when(code.isin(*own), fam).otherwise(family)
    cited = F.when(i % 5 == 0, F.lit("nowhere")).otherwise(F.col("turn_id"))
    item = F.concat(F.lit('{"turn_id":'), js(cited), F.lit(',"quote":'), js(F.when(i % 9 == 0, F.concat("shown", F.lit(" and more"))).otherwise(F.col("shown"))), F.lit("}"))
    evidence = F.when(i % 31 == 0, F.concat(item, F.lit(',"a string"'))).otherwise(F.array_join(F.array_repeat(item, (i % 4).cast("int")), ","))
    record = F.concat(
        F.lit('{"codebook_code":'), js(code), F.lit(',"unit":'), js(_pick((*C.UNITS, "turn", "turn", "turn", "cross_session"), i)), F.lit(',"source_reliability":'), js(_pick((*C.SOURCE_RELIABILITY, "G"), i)), F.lit(',"info_credibility":'), _pick(_CRED, i),
        F.lit(',"statement":'), js(F.col("shown")), F.lit(',"facets":{"delivery":'), js(_pick((*C.DELIVERY_VALUES, "x"), i)), F.lit(',"cause":'), js(_pick(C.CAUSE_VALUES, i)), F.lit('},"confidence":'), _pick(_CONFIDENCE, i), F.lit(',"evidence":['), evidence, F.lit("]}"),
    )
    rows = t.select("window_id", family.alias("family"), "idx", F.when(i % 29 == 0, F.lit('"no object"')).otherwise(record).alias("r"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "r"))), lambda x: x["r"]), ",")
    odd = F.substring(F.md5(F.concat("window_id", "family")), 1, 1) == "0"
    payload = rows.groupBy("window_id", "family").agg(listed.alias("l")).select("window_id", "family", F.when(odd, F.lit('{"records": {"a": 1}}')).otherwise(F.concat(F.lit('{"records": ['), "l", F.lit("]}"))).alias("payload"))
    return payload, t.select("window_id", "turn_id", "idx", "actor", "shown")


def payload_validation(spark, root):
    """Outcome of each candidate of JSON payloads; the payloads are scaffolding made from turns."""
    return validate.validated(*_payloads(spark, root)).select("window_id", "family", F.coalesce("position", F.lit(-1)).cast("int").alias("position"), "reason", F.when(F.col("shape").isNull(), F.col("confidence")).alias("confidence"), F.when(F.col("reason").isNull(), F.col("info_credibility")).alias("credibility"))


def rejection_causes(spark, root):
    return validate.rejection_causes(validate.validated(*_payloads(spark, root)))


def evidence_rebinding(spark, root):
    """Quotes of the records table, whole, that cite the turn after theirs, resolved among the turns of the window of theirs.

    Windows, their turns and the home of each quote are found on ids and numbers; texts join them for homes alone.
    """
    turns = table(spark, root, "turns")
    shown = F.coalesce(sensitivity.masked(F.col("text"))["text"], F.lit(""))
    sized = cut_lineage(turns.withColumn("shown", shown).select("turn_id", "session_id", "idx", "actor", windows.token_estimate(F.col("shown")).alias("tokens")).dropDuplicates(["turn_id"]))
    w = windows.windows(sized.select("session_id", "idx", "tokens", F.lit(0).alias("flags")), LIMIT, OVERLAP)  # the families aren't asked for
    m = windows.members(w.drop("tokens", "flags"), sized.drop("tokens"))
    places = cut_lineage(m.select(windows.window_id().alias("window_id"), "turn_id", "idx", "actor"))
    e = _records(spark, root).select("record_id", F.posexplode(F.from_json("evidence_json", validate.EVIDENCE)).alias("item", "e")).select("record_id", "item", "e.turn_id", "e.quote")
    of = places.groupBy("turn_id").agg(F.min("window_id").alias("window_id"))
    shifted = F.concat(F.regexp_extract("turn_id", r"^(.*:)\d+$", 1), (F.regexp_extract("turn_id", r":(\d+)$", 1).cast("int") + 1).cast("string"))
    cand = cut_lineage(e.join(of, "turn_id").select("window_id", F.col("record_id").alias("family"), F.col("item").alias("position"), F.lit(None).cast("string").alias("shape"), F.array(F.struct(shifted.alias("turn_id"), "quote")).alias("evidence")))
    texts = turns.select("turn_id", F.coalesce("text", F.lit("")).alias("shown")).dropDuplicates(["turn_id"])
    homes = cut_lineage(places.join(cand.select("window_id"), "window_id", "left_semi"))
    got = validate.resolved_evidence(cand, homes.join(texts, "turn_id"))
    return got.select("window_id", F.col("family").alias("record_id"), F.col("position").alias("item"), "turn_id", "match_count", "rebound")


def platform_denylist(spark, root):
    """Notices put in the place of some turns, recognised."""
    notices = [*C.NOTICE_EXACT.values(), "Foreground timeout 900s exceeds the maximum of 600s. Use background=true with notify_on_complete=true for long-running commands.", "BLOCKED (hardline): system shutdown/reboot. This command is on the unconditional blocklist and cannot be executed via the agent now", "[Note: model was just switched from a to b via c. Adjust your self-identification accordingly.] and more"]
    quote = F.when(F.col("idx") % 13 == 0, F.concat(F.lit(" "), _pick(notices, F.floor(F.col("idx") / 13).cast("int")), F.lit("\n"))).otherwise(F.col("text"))
    rows = _turns(spark, root).select(quote.alias("first_quote"), F.lit(2).alias("occurrences"))
    return register.purge(rows)[1]


# --- register -----------------------------------------------------------------------------------------


def _keyed(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "cie_records")
    key = register.dedup_key(F.col("codebook_code"), register.evidence_quotes(F.col("evidence_json")), F.col("statement"))
    return r.withColumn("quotes", register.evidence_quotes(F.col("evidence_json"))).select(key.alias("dedup_key"), "record_id", "session_id", "family", "extractor_version", "codebook_code", "statement", F.coalesce("occurrence_count", F.lit(1)).cast("long").alias("occurrences"), "first_seen", "last_seen", "created_at", F.try_element_at("quotes", F.lit(1)).alias("first_quote"))


def dedup_key(spark, root):
    return _keyed(spark, root).select("record_id", "dedup_key")


def dedup_merge(spark, root):
    return register.merge(_keyed(spark, root)).drop("statement")


def dedup_upsert(spark, root):
    """The register of one extractor version with the records of the other merged in."""
    k = _keyed(spark, root)
    old = register.merge(k.where("extractor_version = 'cie-v0'")).withColumn("created_at", F.col("first_seen"))
    return register.upsert(old, k.where("extractor_version = 'cie-v1'")).select("dedup_key", "occurrences", "first_seen", "last_seen")


def occurrence_conservation(spark, root):
    k = _keyed(spark, root)
    return register.conservation(k, register.merge(k))


def _ledger(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    status = _pick(("processed", "processed", "no_signal", "error"), F.col("event_id").cast("int"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("family"), status.alias("status"), F.col("event_id"), (F.col("event_id") % 4).alias("created"), (F.col("event_id") % 3).alias("rejected"))


def window_run_latest(spark, root):
    """The last run of each (session, family); events stand for runs."""
    return register.latest(_ledger(spark, root), ["session_id", "family"], ["event_id"]).select("session_id", "family", "event_id", "status")


def progress_snapshot(spark, root):
    return register.progress(_ledger(spark, root))


def errored_runs(spark, root):
    ledger = _ledger(spark, root).withColumn("window_id", F.col("event_id").cast("string")).withColumn("extractor_version", F.concat(F.lit("v"), (F.col("event_id") % 8).cast("string")))
    return register.errored(ledger, "v3").select("window_id", "session_id", "family")


def work_queue(spark, root):
    s = _turns(spark, root).select("session_id")
    have = s.distinct().where(F.substring(F.md5("session_id"), 1, 1).isin("0", "1", "2", "3")).select("session_id", F.lit("steering").alias("stream"), F.lit("v2").alias("extractor_version"))
    return register.enqueued(s, have, "v2").groupBy("stream", "status").agg(F.count("*").alias("n"))


def stale_work(spark, root):
    """Work items by status after stale ones are reset and failed ones are tried again; events stand for items."""
    status = _pick(("running", "running", "failed", "completed", "pending"), F.col("event_id").cast("int"))
    q = table(spark, root, "events").select(status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    now = F.lit("2024-01-15 12:30:00").cast("timestamp")
    return register.status_counts(register.retry_failed(register.reset_stale(q, now, 30)))


# --- scoring --------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Gold: the register's second extractor version; candidates: the first."""
    k = _keyed(spark, root).select("extractor_version", "session_id", F.col("codebook_code").alias("code"), F.col("first_quote").alias("quote"), F.col("record_id").alias("ord"))
    return k.where("extractor_version = 'cie-v1'"), k.where("extractor_version = 'cie-v0'")


def recall_code_level(spark, root):
    return scoring.scores(scoring.matched_counts(*_sides(spark, root)))


def recall_by_bucket(spark, root):
    sizes = _turns(spark, root).groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", scoring.bucket(F.col("n")).alias("bucket"))
    counts = scoring.matched_counts(*_sides(spark, root)).join(sizes, "session_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("unknown")))
    return scoring.scores(counts, "bucket")


def recall_quote_strict(spark, root):
    return scoring.scores(scoring.strict_counts(*_sides(spark, root)))


def quote_overlap(spark, root):
    """Whether the first quote of each register row shares four words in a row with the turn it cites."""
    e = table(spark, root, "cie_records").select("record_id", F.from_json("evidence_json", validate.EVIDENCE).alias("e")).select("record_id", F.try_element_at("e", F.lit(1)).alias("e")).select("record_id", "e.turn_id", "e.quote")
    j = e.join(_turns(spark, root).select("turn_id", "text"), "turn_id")
    return j.select("record_id", F.arrays_overlap(scoring.ngrams(F.col("quote")), scoring.ngrams(F.col("text"))).alias("overlaps"))


def wilson_ci(spark, root):
    e = table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.sum(F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("hits"))
    lo, hi = scoring.wilson(F.col("hits"), F.col("total"))
    return e.select("event_type", "hits", "total", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def evidence_integrity(spark, root):
    """Faults of evidence links, some of which are broken on purpose: an eighth of the records gets another turn or quote."""
    e = _records(spark, root).select("record_id", F.explode(F.from_json("evidence_json", validate.EVIDENCE)).alias("e")).select("record_id", "e.turn_id", "e.quote")
    hit = lambda n: F.substring(F.md5("record_id"), 1, 1) == n
    e = e.withColumn("turn_id", F.when(hit("0"), F.concat("turn_id", F.lit("x"))).otherwise(F.col("turn_id"))).withColumn("quote", F.when(hit("1"), F.concat("quote", F.lit(" (sic)"))).otherwise(F.col("quote")))
    return scoring.integrity(e, _turns(spark, root))


def run_mean_sd(spark, root):
    runs = table(spark, root, "events").groupBy("event_type", (F.col("event_id") % 3).alias("run")).agg(F.avg("value").alias("score"))
    return scoring.mean_sd(runs, "score", "event_type")


def transport_stats(spark, root):
    return scoring.transport(_ledger(spark, root).withColumn("valid_json", F.col("event_id") % 10 != 0), "family")


def _outcomes(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "cie_records")
    get = lambda k: F.get_json_object("facets_json", f"$.{k}")
    return r.select(F.col("codebook_code").alias("code"), get("delivery").alias("delivery"), get("cause").alias("cause"))


def outcome_distribution(spark, root):
    return scoring.deliveries(_outcomes(spark, root))


def rework_causes(spark, root):
    return scoring.outcomes(_outcomes(spark, root))


def bucket_sessions(spark, root):
    n = _turns(spark, root).groupBy("session_id").agg(F.count("*").alias("n"))
    return n.groupBy(scoring.bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("sessions"), F.sum("n").cast("long").alias("turns"))


def stratified_sample(spark, root):
    s = _turns(spark, root).groupBy("session_id").agg(F.count("*").alias("n")).withColumn("bucket", scoring.bucket(F.col("n")))
    return scoring.stratified_sample(s, 5, "seed-7:").select("bucket", "session_id", "rank")


def session_coverage(spark, root):
    return scoring.coverage(table(spark, root, "cie_records"))


# --- reports -----------------------------------------------------------------------------------------------


def topk_findings(spark, root):
    return reports.top_findings(_keyed(spark, root), 10).select("family", "rank", "record_id", "occurrences")


def pilot_counts(spark, root):
    return reports.pilot_counts(_records(spark, root))


def pilot_examples(spark, root):
    return reports.pilot_examples(_records(spark, root)).select("stream", "pattern_type", "rank", "record_id")


def shown_quotes(spark, root):
    """First quotes of the records as a report shows them."""
    r = _records(spark, root).select("record_id", "sensitivity", F.try_element_at(F.from_json("evidence_json", validate.EVIDENCE), F.lit(1))["quote"].alias("quote"))
    return reports.shown_quotes(r.where("quote IS NOT NULL")).select("record_id", "shown")


def usage_cost(spark, root):
    """Cost by event type; events stand for calls."""
    i = F.col("event_id")
    js = F.to_json(F.struct((i % 1000).alias("prompt_tokens"), (i % 300).alias("output_tokens"), F.when(i % 2 == 0, i % 1400).alias("total_tokens"), F.when(i % 3 == 0, i * 100).alias("cost_in_usd_ticks")))
    calls = table(spark, root, "events").select("event_type", F.when(i % 7 == 0, "other").otherwise("grok-4.3").alias("model"), usage.normalised(js).alias("u")).select("event_type", "model", "u.*")
    return usage.costs(calls, "event_type").select("event_type", "model", "calls", "priced", "total", "reasoning", "exact_usd", "estimated_usd", "effective_usd", "cost_source")


QUERIES = (
    turns_normalized, turn_offsets, actor_turn_counts, skip_rule_counts, exclude_feedback_sessions, newest_n_sessions, content_hash_changes, transcript_files, transcript_messages, replaced_sessions, token_estimate, session_windows, window_ids, window_overlap_turns,
    family_routing, no_signal_windows, planned_prompts, resume_remaining, prompt_clip_tier, prompt_examples, pass_cards, sensitivity_level, secret_hit_counts, masked_text, question_signals, correction_signals, tool_failures, methodology_signals,
    methodology_sinks, brief_text, evidence_quote, signal_caps, signal_records, payload_validation, rejection_causes, evidence_rebinding, platform_denylist, dedup_key, dedup_merge, dedup_upsert, occurrence_conservation,
    window_run_latest, progress_snapshot, errored_runs, work_queue, stale_work, recall_code_level, recall_by_bucket, recall_quote_strict, quote_overlap, wilson_ci, evidence_integrity, run_mean_sd, transport_stats,
    outcome_distribution, rework_causes, bucket_sessions, stratified_sample, session_coverage, topk_findings, pilot_counts, pilot_examples, shown_quotes, usage_cost,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
