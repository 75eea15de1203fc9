"""Validation of candidate findings: the first failing rule names the rejection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions.text import strip

#: Type of evidence lists that are known to be well-formed.
EVIDENCE = "array<struct<turn_id:string,quote:string>>"


def notice_id(quote: Column) -> Column:
    """Name of the platform notice that `quote` is, as a whole; null otherwise."""
    t = strip(quote)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(C.NOTICE_PATTERNS.items()):
        out = F.when(t.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    for name, text in reversed(C.NOTICE_EXACT.items()):
        out = F.when(t == text, name).otherwise(out)
    return out


def whole_number(c: Column) -> Column:
    """Integer of a number (cut towards zero), a string of digits or a truth value; null for anything else. `c` is the JSON text of the value."""
    bare = F.trim(c)
    quoted = F.regexp_extract(bare, r'^"\s*([+-]?\d+)\s*"$', 1)
    number = bare.try_cast("double")
    return F.when(bare.startswith('"'), quoted.try_cast("int")).when(bare == "true", 1).when(bare == "false", 0).otherwise(F.when(number.isNotNull(), number.try_cast("int")))


def confidence(c: Column) -> Column:
    """low, medium or high of a name in any case or of a number (from 0.45 medium, from 0.75 high; true is 1); anything else, a number in quotes too, is low.

    `c` is the JSON text of the value.
    """
    bare = F.trim(c)
    name = F.lower(F.regexp_extract(bare, r'^"(.*)"$', 1))
    n = F.when(bare == "true", F.lit(1.0)).when(~bare.startswith('"'), bare.try_cast("double"))
    return F.when(name.isin(*C.CONFIDENCE), name).when(n >= 0.75, "high").when(n >= 0.45, "medium").otherwise("low")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _member(v: Column, path: str) -> Column:
    """JSON text of a member, with its quotes if it is a string; null where there is none."""
    return F.to_json(F.try_variant_get(v, f"$.{path}", "variant"))


def payload_records(payloads: DataFrame) -> DataFrame:
    """Candidates of payload texts (window_id, family, payload): one row a record with its position, or one row for a payload that holds no list.

    `shape` is `records_not_list`, `record_not_object`, or null. Members that decide by their type stay JSON text; `evidence` is
    an array of (object, turn_id, quote), one for each item whatever it is, and null where there is no list.
    """
    parsed = payloads.withColumn("_v", F.try_variant_get(F.try_parse_json("payload"), "$.records", "variant")).withColumn("_l", _is(F.col("_v"), "ARRAY"))
    rows = parsed.select("window_id", "family", "_l", F.posexplode_outer(F.when(F.col("_l"), F.try_variant_get("_v", "$", "array<variant>"))).alias("position", "_r")).where("NOT (_l AND position IS NULL)")
    r = F.col("_r")
    text = lambda k: F.when(_is(F.try_variant_get(r, f"$.{k}", "variant"), "STRING"), F.try_variant_get(r, f"$.{k}", "string"))
    shape = F.when(~F.col("_l"), "records_not_list").when(~_is(r, "OBJECT"), "record_not_object")
    listed = F.when(_is(F.try_variant_get(r, "$.evidence", "variant"), "ARRAY"), F.try_variant_get(r, "$.evidence", "array<variant>"))
    quote = lambda x: F.when(_is(F.try_variant_get(x, "$.quote", "variant"), "STRING"), F.try_variant_get(x, "$.quote", "string"))
    evidence = F.transform(listed, lambda x: F.struct(_is(x, "OBJECT").alias("object"), F.try_variant_get(x, "$.turn_id", "string").alias("turn_id"), quote(x).alias("quote")))
    rest = {"facets": "{}", "assumptions": "[]", "alternative_interpretations": "[]", "disconfirming_evidence": "[]", "falsifiers": "[]"}
    return rows.select(
        "window_id", "family", "position", F.to_json(r).alias("record"), shape.alias("shape"), *[text(k).alias(k) for k in ("codebook_code", "unit", "statement", "source_reliability", "actor", "sensitivity")],
        _member(r, "info_credibility").alias("info_credibility"), text("facets.delivery").alias("delivery"), text("facets.cause").alias("cause"), evidence.alias("evidence"), _member(r, "confidence").alias("confidence"),
        F.coalesce(text("confidence_basis"), F.lit("")).alias("confidence_basis"), *[F.coalesce(_member(r, k), F.lit(v)).alias(k) for k, v in rest.items()],
    )


def resolved_evidence(candidates: DataFrame, surface: DataFrame) -> DataFrame:
    """Evidence items rebound to turns: (window_id, family, position, item, turn_id, quote, cited_turn_id, actor, match_count, rebound).

    `surface` has (window_id, turn_id, idx, actor, shown). A quote that isn't in the turn it
    cites goes to the first turn of the window that holds it. The join is an equality on
    the window, whose turns its token budget bounds.
    """
    items = candidates.where("shape IS NULL").select("window_id", "family", "position", F.posexplode("evidence").alias("item", "e")).select("window_id", "family", "position", "item", F.col("e.turn_id").alias("cited_turn_id"), F.col("e.quote").alias("quote"))
    # one shuffle of either side, by the window: what follows is grouped within it
    told = surface.select(F.col("window_id").alias("_window"), F.col("turn_id").alias("_turn"), F.col("idx").alias("_idx"), F.col("actor").alias("_actor"), "shown")
    met = items.join(told, F.expr("window_id = _window AND quote <> '' AND instr(shown, quote) > 0"), "left")
    hit = F.struct((F.col("_turn") != F.coalesce("cited_turn_id", F.lit(""))).alias("other"), F.col("_idx").alias("idx"), F.col("_turn").alias("turn_id"), F.col("_actor").alias("actor"))
    key = ["window_id", "family", "position", "item"]
    found = met.groupBy(*key, "quote", "cited_turn_id").agg(F.min(F.when(F.col("_turn").isNotNull(), hit)).alias("b"), F.count("_turn").alias("match_count"))
    return found.select(*key, F.col("b.turn_id").alias("turn_id"), "quote", "cited_turn_id", F.col("b.actor").alias("actor"), "match_count", F.coalesce("b.other", F.lit(False)).alias("rebound"))


def reason(
    *, shape: Column, code: Column, codes: Column, unit: Column, reliability: Column, credibility: Column, n_evidence: Column, bad_item: Column, first_quote: Column,
    statement: Column, quotes: Column, delivery: Column, cause: Column, actors: Column,
) -> Column:
    """The first rule that fails, in the order that is part of the contract; null for an accepted record.

    `codes` is the array of codes of the pass, `quotes` all quotes as one text, `actors` the
    actors of the evidence, `bad_item` what is wrong with the first of the `n_evidence` items that fails.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    number = whole_number(credibility)
    outcome = F.coalesce(code.isin(*C.OUTCOME_CODES), F.lit(False))
    rules = [
        (shape.isNotNull(), shape),
        (no(F.array_contains(codes, code)), F.lit("code_not_allowed")),
        (no(unit.isin(*C.UNITS)), F.lit("unit_not_allowed")),
        (no(reliability.isin(*C.SOURCE_RELIABILITY)), F.lit("source_reliability_not_allowed")),
        (number.isNull(), F.lit("info_credibility_not_int")),
        (~number.between(1, 6), F.lit("info_credibility_out_of_range")),
        (F.coalesce(n_evidence, F.lit(0)) == 0, F.lit("missing_evidence")),
        (bad_item.isNotNull(), bad_item),
        (notice_id(first_quote).isNotNull(), F.lit("platform_primary_evidence_denied")),
        ((code == "model_routing") & no(F.concat_ws(" ", statement, quotes).rlike(C.NAMED_ROUTE)), F.lit("model_routing_without_named_route")),
        (outcome & (no(delivery.isin(*C.DELIVERY_VALUES)) | no(cause.isin(*C.CAUSE_VALUES))), F.lit("outcome_facets_invalid")),
        ((code == "rework_cause") & ~(delivery.isin(*C.REWORK_DELIVERIES) & cause.isin(*C.REAL_CAUSES)), F.lit("rework_cause_without_real_cause")),
        (((code == "intent_stated") & ~((delivery == "unknown") & (cause == "none"))) | ((code == "delivery_result") & delivery.isin("landed", "unknown") & (cause != "none")), F.lit("outcome_facets_invalid")),
        ((reliability == "A") & no(F.arrays_overlap(actors, F.array(*[F.lit(a) for a in C.DIRECT_ACTORS]))), F.lit("source_reliability_a_without_direct_source")),
    ]
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), rule[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def capped(judged: DataFrame, most: int = C.MAX_RECORDS_PER_PAYLOAD) -> DataFrame:
    """Accepted records beyond the first `most` of a payload are rejected as too many; rejected ones don't count."""
    rank = F.row_number().over(Window.partitionBy("window_id", "family", F.col("reason").isNull()).orderBy("position"))
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (rank > most), "too_many_records").otherwise(F.col("reason")))


def validated(payloads: DataFrame, surface: DataFrame, most: int = C.MAX_RECORDS_PER_PAYLOAD) -> DataFrame:
    """Every record of the payloads with its reason (null: accepted) and its resolved evidence."""
    cand = payload_records(payloads)
    ev = resolved_evidence(cand, surface)
    key = ["window_id", "family", "position"]
    got = ev.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("item", "turn_id", "quote", "actor", "cited_turn_id", "rebound", "match_count"))).alias("resolved"))
    codes = F.lit(None).cast("array<string>")
    for fam, own in {**C.PASS_CODES, "all": C.ALL_CODES}.items():
        codes = F.when(F.col("family") == fam, F.array(*[F.lit(c) for c in own])).otherwise(codes)
    rows = cand.join(got, key, "left")
    # items in order: the first that is no object, or whose quote isn't found, names the fault
    fault = F.transform(F.arrays_zip(F.transform("evidence", lambda e: e["object"]).alias("o"), F.transform("resolved", lambda x: x["turn_id"]).alias("t")), lambda z: F.when(~z["o"], "evidence_not_object").when(z["t"].isNull(), "quote_not_found"))
    why = reason(
        shape=F.col("shape"), code=F.col("codebook_code"), codes=codes, unit=F.col("unit"), reliability=F.col("source_reliability"), credibility=F.col("info_credibility"), n_evidence=F.coalesce(F.size("evidence"), F.lit(0)),
        bad_item=F.try_element_at(F.filter(fault, lambda x: x.isNotNull()), F.lit(1)), first_quote=F.try_element_at("resolved", F.lit(1))["quote"], statement=F.col("statement"), quotes=F.array_join(F.transform("resolved", lambda x: x["quote"]), " "), delivery=F.col("delivery"), cause=F.col("cause"),
        actors=F.transform("resolved", lambda x: x["actor"]),
    )
    judged = capped(rows.withColumn("reason", why), most)
    return judged.withColumn("confidence", confidence(F.col("confidence"))).withColumn("info_credibility", whole_number(F.col("info_credibility"))).withColumn("quote_verified", F.col("reason").isNull())


def rejection_causes(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
