"""From messages to turns: roles, texts, skipping, positions and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions.text import contains_any, non_empty, starts_with_any, strip
from loomline.operators.scan import running_total


def actor(role: Column) -> Column:
    """Actor of a role, in any case; an empty or missing role is `unknown`."""
    low = F.lower(F.coalesce(role, F.lit("")))
    out = F.when(low == "", "unknown").otherwise(low)
    for r, a in C.ROLE_ACTORS.items():
        out = F.when(low == r, a).otherwise(out)
    return out


def message_text(content: Column) -> Column:
    """Text of a message's content given as JSON: a string, or a list whose items are strings or carry `text` or `content`.

    A list is joined by line breaks; anything else is its JSON text; null is empty.
    """
    v = F.try_parse_json(content)
    kind = lambda x: F.schema_of_variant(x)
    member = lambda x, k: F.when(kind(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING", F.try_variant_get(x, f"$.{k}", "string"))
    part = lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(kind(x).startswith("OBJECT"), F.coalesce(non_empty(member(x, "text")), member(x, "content")))
    joined = F.array_join(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), lambda x: x.isNotNull()), "\n")
    return F.when(content.isNull(), "").when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(v).startswith("ARRAY"), F.coalesce(joined, F.lit(""))).otherwise(content)


def first_field(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[non_empty(c) for c in cols])


def skip_rules(role: Column, tool: Column, text: Column) -> dict[str, Column]:
    """The reasons to skip a message, each a condition that is never null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    name, who = F.coalesce(tool, F.lit("")), F.coalesce(role, F.lit(""))
    return {
        "blank": (strip(low) == "") & (name == ""),
        "system": who == "system",
        "compaction": contains_any(low, C.SKIP_COMPACTION),
        "important": low.startswith(C.SKIP_IMPORTANT_PREFIX) | contains_any(low, C.SKIP_IMPORTANT),
        "task_list": low.startswith(C.SKIP_TASK_LIST_PREFIX),
        "skill_dump": contains_any(low, C.SKIP_SKILL_DUMP),
        "skill_tool": name.isin(*C.SKIP_TOOLS),
        "other_tool": (who == "tool") & ~name.isin(*C.KEPT_TOOLS),
        "tool_definitions": low.contains("tool definitions") & low.contains("namespace"),
    }


def skipped(role: Column, tool: Column, text: Column) -> Column:
    out = F.lit(False)
    for rule in skip_rules(role, tool, text).values():
        out = out | rule
    return out


def turns(messages: DataFrame, prefix: str = "") -> DataFrame:
    """Kept turns of positioned messages (session_id, idx, role, text, tool_name, ts).

    `idx` is the position among all messages, so gaps stay where messages were
    skipped. Rows without session or position are dropped; nulls in text count as empty.
    """
    role = F.lower(strip(F.coalesce("role", F.lit(""))))
    kept = messages.where(F.col("session_id").isNotNull() & F.col("idx").isNotNull()).withColumn("_r", role).where(~skipped(F.col("_r"), F.col("tool_name"), F.col("text")))
    sid = F.concat(F.lit(prefix), "session_id")
    return kept.select(
        F.concat_ws(":", sid, F.col("idx").cast("string")).alias("turn_id"), sid.alias("session_id"), F.col("idx").cast("int").alias("idx"), actor(F.col("_r")).alias("actor"),
        F.col("ts"), F.coalesce("text", F.lit("")).alias("text"), non_empty(F.col("tool_name")).alias("tool_name"),
    )


def positioned(messages: DataFrame, order: str = "id") -> DataFrame:
    """Messages, each once by (session_id, `order`), with `idx`, their position in the session by `order`.

    Only ids are numbered; the texts meet their number in one join, on which the re-delivered rows are dropped too.
    """
    once = messages.dropDuplicates(["session_id", order])
    ids = messages.select("session_id", order).distinct().withColumn("_one", F.lit(1))
    return once.join(running_total(ids, "session_id", order, "_one", "idx"), ["session_id", order])


def with_offsets(kept: DataFrame) -> DataFrame:
    """Turns with their character offsets: each begins one past the end of the one before."""
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    sized = kept.select("session_id", "idx", (size + 1).alias("_n"))
    done = running_total(sized, "session_id", "idx", "_n", "char_start").withColumn("idx", F.col("idx").cast("int"))
    return kept.withColumn("_n", size).join(done, ["session_id", "idx"]).withColumn("char_end", F.col("char_start") + F.col("_n")).select(*kept.columns, "char_start", "char_end")


def excluded_sessions(sessions: DataFrame, messages: DataFrame, terms=C.EXCLUDE_TERMS) -> DataFrame:
    """(session_id) of sessions that mention one of `terms` in a field or a message. Terms are compared without case."""
    low = [t.lower() for t in terms]
    fields = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in sessions.columns]))
    a = sessions.where(contains_any(fields, low)).select(F.col("id").alias("session_id"))
    b = messages.where(contains_any(F.lower(F.coalesce("content", F.lit(""))), low) & F.col("session_id").isNotNull()).select("session_id")
    return a.union(b).distinct()


def newest_sessions(sessions: DataFrame, excluded: DataFrame | None = None, limit: int = 20, after: float | None = None) -> DataFrame:
    """The newest eligible sessions: with messages, started after the cursor, not excluded; `limit` 0 takes all. Ties go to the larger id."""
    ok = sessions.where("message_count > 0")
    if after is not None:
        ok = ok.where(F.col("started_at") > after)
    if excluded is not None:
        ok = ok.join(excluded.select(F.col("session_id").alias("id")), "id", "left_anti")
    ok = ok.orderBy(F.desc_nulls_last("started_at"), F.desc("id"))
    return ok.limit(limit) if limit > 0 else ok


def content_hashes(kept: DataFrame) -> DataFrame:
    """(session_id, content_hash): a digest of the kept turns of each session, whatever their number.

    Each turn is hashed with its position, and the digests are combined by sums of
    their halves, so that no session is ever gathered; equal content gives equal hashes.
    """
    d = F.sha2(F.concat_ws("\u001f", F.col("idx").cast("string"), "actor", F.coalesce("tool_name", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    part = lambda i: F.sum(F.conv(F.substring("_d", i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = kept.withColumn("_d", d).groupBy("session_id").agg(part(1).alias("a"), part(16).alias("b"), F.count("*").alias("n"))
    return sums.select("session_id", F.substring(F.sha2(F.concat_ws(":", "a", "b", F.col("n").cast("string")), 256), 1, 16).alias("content_hash"))


def changed_sessions(hashes: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions that are new or whose hash differs from the stored one."""
    return hashes.join(stored.select("session_id", "content_hash"), ["session_id", "content_hash"], "left_anti")


def replace_sessions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored turns with those of the fresh sessions replaced."""
    return stored.join(fresh.select("session_id").distinct(), "session_id", "left_anti").unionByName(fresh)


__all__ = ["actor", "changed_sessions", "content_hashes", "excluded_sessions", "first_field", "message_text", "newest_sessions", "positioned", "replace_sessions", "skip_rules", "skipped", "starts_with_any", "turns", "with_offsets"]
