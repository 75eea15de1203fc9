"""Prompts of passes: code cards and examples from the codebook, and turn lines clipped to a budget."""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.functions.text import collapse, tokens_of

#: The codebook that comes with the package; another file of the same form may be given.
CODEBOOK = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "codebook.json")
#: Most examples of a pass, and most near misses among them.
SHOTS, OTHER_SHOTS, NEAR_MISSES = {"all": 5, "outcome_attribution": 9}, 6, 2
_CODE = "ord int, code string, family string, definition string, unit array<string>, includes array<string>, excludes array<string>"
_SHOT = "ord int, codebook_code string, source string, near_miss boolean, faceted boolean, card string"


def allowed_codes(family: str) -> tuple[str, ...]:
    """Codes a pass may give; `all` may give any."""
    family = C.FAMILY_ALIASES.get(family, family)
    return C.ALL_CODES if family == "all" else C.PASS_CODES.get(family, ())


def codebook(spark: SparkSession, path: str = CODEBOOK) -> dict[str, DataFrame]:
    """The tables of a codebook file: `codes`, `few_shots`, `passes` (family, code, with the combined pass `all`) and `rules`. A codebook is a small document."""
    with open(path, encoding="utf-8") as f:
        book = json.load(f)
    codes = [(i, *[c.get(k) for k in ("code", "family", "definition", "unit", "includes", "excludes")]) for i, c in enumerate(book["codes"])]
    shots = [(i, s.get("codebook_code"), s.get("family"), bool(s.get("near_miss")), bool(s.get("facets")), json.dumps(s, ensure_ascii=False)) for i, s in enumerate(book["few_shots"])]
    passes = [(p["family"], c) for p in book["passes"] for c in p["codes"]]
    passes += [("all", c) for _, c in passes]
    return {
        "codes": spark.createDataFrame(codes, _CODE), "few_shots": spark.createDataFrame(shots, _SHOT), "passes": spark.createDataFrame(passes, "family string, code string"),
        "rules": spark.createDataFrame(list(enumerate(book["prompt_rules"])), "ord int, rule string"),
    }


def code_cards(codes: DataFrame, passes: DataFrame) -> DataFrame:
    """(family, ord, card): the codes of each pass as JSON; cards of the combined pass keep two inclusions and exclusions."""
    brief = F.col("p.family") == "all"
    few = lambda c: F.when(brief, F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 2)).otherwise(F.col(c)).alias(c)
    rows = codes.alias("c").join(F.broadcast(passes).alias("p"), F.col("c.code") == F.col("p.code"))
    return rows.select(F.col("p.family").alias("family"), "ord", F.to_json(F.struct("c.code", F.col("c.family").alias("family"), "definition", "unit", few("includes"), few("excludes"))).alias("card"))


def few_shots(examples: DataFrame, passes: DataFrame) -> DataFrame:
    """(family, place, ord, card): the examples of each pass in their order.

    An example belongs to the passes that may give its code, and to the pass it was taken from. By
    rank in the codebook, examples fill the places that near misses leave free, and near misses theirs. In the
    combined pass the first rework cause with facets has the last of those places if its rank is beyond them.
    """
    by_code = examples.join(passes, examples.codebook_code == passes.code).select("family", *examples.columns)
    by_source = examples.join(passes.select("family").distinct(), F.col("source") == F.col("family")).select("family", *examples.columns)
    mine = by_code.unionByName(by_source).dropDuplicates(["family", "ord"])
    total = F.lit(OTHER_SHOTS)
    for family, n in SHOTS.items():
        total = F.when(F.col("family") == family, n).otherwise(total)
    kind = ["family", "near_miss"]
    rework = (F.col("family") == "all") & (F.col("codebook_code") == "rework_cause") & F.col("faceted") & ~F.col("near_miss")
    ranked = mine.withColumn("room", F.when(F.col("near_miss"), NEAR_MISSES).otherwise(total - NEAR_MISSES)).withColumn("rank", F.row_number().over(Window.partitionBy(*kind).orderBy("ord")))
    forced = rework & (F.min(F.when(rework, F.col("ord"))).over(Window.partitionBy("family")) == F.col("ord"))
    seated = ranked.withColumn("forced", forced).withColumn("seat", F.when(F.col("forced"), F.least("rank", "room")).otherwise(F.col("rank")))
    seated = seated.withColumn("seat", F.row_number().over(Window.partitionBy(*kind).orderBy("seat", F.desc("forced"), "ord"))).where("seat <= room")
    return seated.select("family", F.row_number().over(Window.partitionBy("family").orderBy("near_miss", "seat")).alias("place"), "ord", "card")


def heads(book: dict[str, DataFrame]) -> dict[str, str]:
    """The part of the prompt before the turns, by pass. The codebook's selections are small and read on the driver."""
    cards, shots = defaultdict(list), defaultdict(list)
    for r in code_cards(book["codes"], book["passes"]).orderBy("family", "ord").collect():
        cards[r.family].append(r.card)
    for r in few_shots(book["few_shots"], book["passes"]).orderBy("family", "place").collect():
        shots[r.family].append(r.card)
    rules = [r.rule for r in book["rules"].orderBy("ord").collect()]
    return {f: instructions(f, cards[f], shots[f], rules) for f in cards}


def instructions(family: str, cards: Sequence[str] = (), shots: Sequence[str] = (), rules: Sequence[str] = ()) -> str:
    """The text before the turns from JSON cards and examples."""
    schema = {"records": [{"codebook_code": "", "unit": "|".join(C.UNITS), "statement": "", "actor": "", "source_reliability": "|".join(C.SOURCE_RELIABILITY), "info_credibility": 1, "facets": {"delivery": "|".join(C.DELIVERY_VALUES), "cause": "|".join(C.CAUSE_VALUES)}, "evidence": [{"turn_id": "", "quote": ""}], "assumptions": [""], "alternative_interpretations": [{"interpretation": "", "why_less_likely": ""}], "disconfirming_evidence": [""], "falsifiers": [""], "confidence": "|".join(C.CONFIDENCE), "confidence_basis": "", "sensitivity": "|".join(C.SENSITIVITY_LEVELS)}]}
    parts = [f"Family: {family}", "Codes: [" + ", ".join(cards or [json.dumps(c) for c in allowed_codes(family)]) + "]"]
    parts += ["Examples: [" + ", ".join(shots) + "]"] if shots else []
    parts += [*rules, "Answer with JSON only, at most %d records, quotes copied letter by letter: %s" % (C.MAX_RECORDS_PER_PAYLOAD, json.dumps(schema)), "Turns:"]
    return "\n".join(parts)


def clipped(text: Column, chars: int) -> Column:
    t = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("…"))).otherwise(t)


def line(text: Column) -> Column:
    tool = F.when(F.coalesce("tool_name", F.lit("")) != "", F.concat(F.lit(" tool="), "tool_name")).otherwise("")
    return F.concat(F.lit("turn_id="), "turn_id", F.lit(" idx="), F.col("idx").cast("string"), F.lit(" actor="), "actor", tool, F.lit(": "), text)


def tiers(members: DataFrame, text: str = "text", chars: Sequence[int] = C.TURN_CHARS) -> DataFrame:
    """(session_id, window_index, n1, n2, n3): characters of the lines of each window at the three clips, one line break a line."""
    size = [F.sum(F.length(line(clipped(F.col(text), c))) + 1).cast("long").alias(f"n{i}") for i, c in enumerate(chars, 1)]
    return members.groupBy("session_id", "window_index").agg(*size)


def clip_tier(n1: Column, n2: Column, instruction_chars: Column, limit: int = C.MAX_PROMPT_TOKENS) -> Column:
    """1, 2 or 3: the widest clip whose prompt fits; the last isn't checked."""
    fits = lambda n: tokens_of(n + instruction_chars) <= limit
    return F.when(fits(n1), 1).when(fits(n2), 2).otherwise(3)


def bundles(members: DataFrame, plan: DataFrame, heads: dict[str, str], text: str = "text", limit: int = C.MAX_PROMPT_TOKENS) -> DataFrame:
    """(session_id, window_index, family, tier, prompt, prompt_hash, quote_sources) of planned passes.

    The turns of a window are gathered, which its token budget bounds; turns are never dropped.
    """
    t = tiers(members, text)
    head = F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])
    passes = plan.select("session_id", "window_index", "family").join(t, ["session_id", "window_index"])
    passes = passes.withColumn("head", F.element_at(head, F.col("family"))).withColumn("tier", clip_tier(F.col("n1"), F.col("n2"), F.length("head"), limit))
    clip = F.col("tier")
    shown = F.when(clip == 1, clipped(F.col(text), C.TURN_CHARS[0])).when(clip == 2, clipped(F.col(text), C.TURN_CHARS[1])).otherwise(clipped(F.col(text), C.TURN_CHARS[2]))
    rows = passes.join(members, ["session_id", "window_index"]).withColumn("shown", shown)
    got = rows.groupBy("session_id", "window_index", "family", "tier", "head").agg(F.array_sort(F.collect_list(F.struct("idx", line(F.col("shown")).alias("line"), "turn_id", "shown"))).alias("t"))
    got = got.withColumn("prompt", F.concat_ws("\n", "head", F.array_join(F.transform("t", lambda x: x["line"]), "\n")))
    return got.select(
        "session_id", "window_index", "family", "tier", "prompt", F.substring(F.sha2("prompt", 256), 1, 16).alias("prompt_hash"),
        F.map_from_entries(F.transform("t", lambda x: F.struct(x["turn_id"], x["shown"]))).alias("quote_sources"),
    )
