"""Rule-based findings: one turn gives none to several records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions.text import brief, collapse, contains_any, cut_at_word, short_hash, starts_with_any, strip, word_hits
from loomline.operators.sensitivity import quick_level


def is_question(c: Column) -> Column:
    """Ends in a question mark and begins with a question word, links and inline code aside."""
    bare = collapse(F.regexp_replace(F.regexp_replace(c, r"https?://\S+", ""), r"`[^`]*`", ""))
    return bare.endswith("?") & bare.rlike(C.QUESTION_START)


def is_correction(c: Column) -> Column:
    return c.rlike(C.CORRECTION)


def limits_authority(c: Column) -> Column:
    return F.lower(c).rlike(C.AUTHORIZATION)


def is_tool_failure(c: Column) -> Column:
    """A traceback or error line; or a failure line together with a non-zero exit code."""
    return c.rlike(C.FAILURE_CERTAIN) | (F.lower(c).rlike(C.FAILURE_EXIT) & c.rlike(C.FAILURE_LINE))


def is_method(c: Column) -> Column:
    """Two or more words of method, unless it begins like a status."""
    low = strip(F.lower(c))
    return ~starts_with_any(low, C.METHOD_STATUS_PREFIXES) & (word_hits(low, C.METHOD_WORDS) >= 2)


def method_sink(c: Column) -> Column:
    low = F.replace(strip(F.lower(c)), F.lit("’"), F.lit("'"))
    reusable = contains_any(low, C.METHOD_REUSABLE)
    return (
        F.when(starts_with_any(low, C.METHOD_REPORT_PREFIXES), "report_only")
        .when(reusable, "skill_candidate")
        .when(starts_with_any(low, C.METHOD_NEAR_TERM), "report_only")
        .when(word_hits(low, C.METHOD_STRUCTURE) >= 3, "skill_candidate")
        .otherwise("report_only")
    )


def dedupe_text(c: Column) -> Column:
    """Text for identity: one line, lower case, numbers and ids as placeholders, two templates as one word."""
    t = F.lower(collapse(c))
    t = F.regexp_replace(t, r"\bba-m\d+-\d+\b", "ba-m#")
    t = F.regexp_replace(t, r"\bproc_\w+\b", "proc_#")
    t = F.regexp_replace(t, r"\b\d+\b", "#")
    both = t.contains("fable") & t.contains("review")
    return F.when(t.startswith("full verification is green") & both, "template:full-verification-green-fable-review").when(t.startswith("i'm invoking") & both, "template:invoking-fable-review").otherwise(t)


def _branch(rule: Column, stream: str, kind: Column, cap_key: Column, cap: int, intro: Column, by: Column, sink: Column, confidence: float, order: int) -> Column:
    return F.when(rule, F.struct(
        F.lit(stream).alias("stream"), kind.alias("pattern_type"), cap_key.alias("cap_key"), F.lit(cap).alias("cap"), intro.alias("intro"), by.alias("by"),
        sink.alias("sink"), F.lit(confidence).alias("confidence"), F.lit(order).alias("branch"),
    ))


def candidates(turns: DataFrame) -> DataFrame:
    """All hits, before caps: the turn's columns with a struct `hit` for each rule that fires."""
    text, who, tool = F.coalesce("text", F.lit("")), F.col("actor"), F.coalesce("tool_name", F.lit(""))
    lit = F.lit
    method = F.when(F.lower(text).contains("fable") | F.lower(text).contains("strategy"), "strategy_review").otherwise("plan_spike_build_verify")
    branches = F.array(
        _branch((who == "user") & is_question(text), "steering", lit("clarification_qa"), lit("clarification_qa"), C.CAPS["clarification_qa"], lit("User asks: "), lit("user"), lit("memory_candidate"), C.CONFIDENCE_DEFAULT, 0),
        _branch((who == "user") & is_correction(text), "steering", F.when(limits_authority(text), "authorization_limit").otherwise("correction"), lit("correction"), C.CAPS["correction"], lit("User sets boundary: "), lit("user"), lit("profile_candidate"), C.CONFIDENCE_CORRECTION, 1),
        _branch((who == "agent") & is_question(text), "behavior", lit("clarification_trigger"), lit("clarification_trigger"), C.CAPS["clarification_trigger"], lit("Agent asks: "), lit("agent"), lit("report_only"), C.CONFIDENCE_DEFAULT, 2),
        _branch((who == "tool") & tool.isin("terminal", "process") & is_tool_failure(text), "behavior", lit("failure_recovery_arc"), lit("failure_recovery_arc"), C.CAPS["failure_recovery_arc"], lit("Terminal/process failure: "), lit("agent"), lit("skill_candidate"), C.CONFIDENCE_DEFAULT, 3),
        _branch((who == "agent") & is_method(text), "methodology", method, method, C.CAPS["methodology"], F.concat(method, lit(": ")), lit("agent"), method_sink(text), C.CONFIDENCE_METHOD, 4),
    )
    return turns.select("turn_id", "session_id", "idx", text.alias("text"), F.explode(F.filter(branches, lambda b: b.isNotNull())).alias("hit"))


def capped(hits: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The first hits of each (session, stream, cap key) in turn order.

    The rank limit is pushed below the shuffle, so a hot session sends at most
    `cap` rows from each task. `caps` replaces limits by cap key.
    """
    key = Window.partitionBy("session_id", "hit.stream", "hit.cap_key").orderBy("idx", "turn_id")
    most = max(C.CAPS.values()) if caps is None else max(caps.values())
    limit = F.col("hit.cap")
    for k, n in (caps or {}).items():
        limit = F.when(F.col("hit.cap_key") == k, n).otherwise(limit)
    return hits.withColumn("rank", F.row_number().over(key)).where(F.col("rank") <= most).where(F.col("rank") <= limit)


def records(hits: DataFrame, stored: DataFrame | None = None, level=quick_level) -> DataFrame:
    """Finding records of capped hits, the first of each id, without those already stored.

    `level` grades the summary with its quote; pass the exact grading where a
    credential's name may hide in another span.
    """
    quote = cut_at_word(strip(F.col("text")), C.QUOTE_CHARS)
    rows = hits.withColumn("quote", quote).where("quote <> ''").withColumn("raw", F.concat("hit.intro", brief(F.col("text"), C.BRIEF_CHARS)))
    rows = rows.withColumn("sensitivity", level(F.concat_ws("\n", "raw", "quote")))
    calm = F.col("sensitivity") == "internal"
    rows = rows.withColumn("summary", F.when(calm, F.col("raw")).otherwise(F.concat("hit.stream", F.lit("/"), "hit.pattern_type", F.lit(" record with suppressed sensitive anchor"))))
    rows = rows.withColumn("evidence_key", dedupe_text(F.col("quote")))
    summary_key = F.when(F.col("evidence_key").startswith("template:"), F.col("evidence_key")).otherwise(dedupe_text(F.col("summary")))
    rid = F.concat(F.lit("rec:"), short_hash(F.concat_ws("\u001f", "session_id", "hit.stream", "hit.pattern_type", "hit.by", summary_key, "evidence_key"), 24))
    sink = F.when(F.col("sensitivity") == "secret", "quarantine").when(~calm & ~F.col("hit.sink").isin("report_only", "quarantine"), "report_only").otherwise(F.col("hit.sink"))
    out = rows.select(
        rid.alias("record_id"), "session_id", F.col("hit.stream").alias("stream"), F.col("hit.pattern_type").alias("pattern_type"), "summary",
        F.array(F.struct("turn_id", F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "quote")).alias("evidence"),
        F.lit("session").alias("scope"), F.col("hit.by").alias("actor"), F.col("hit.confidence").alias("confidence"), "sensitivity",
        F.lit("machine_verified").alias("verification_status"), F.lit("deterministic").alias("extractor"), F.lit(C.DETERMINISTIC_VERSION).alias("extractor_version"),
        sink.alias("recommended_sink"), "idx", F.col("hit.branch").alias("branch"),
    )
    first = Window.partitionBy("record_id").orderBy("idx", "branch")
    out = out.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "idx", "branch")
    return out if stored is None else out.join(stored.select("record_id"), "record_id", "left_anti")
