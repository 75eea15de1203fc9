"""Top lists and counts behind the reports, and their rendering as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.sensitivity import masked


def top_findings(register: DataFrame, k: int) -> DataFrame:
    """The first k findings of each family: most occurrences, then latest, then by statement and id. The rank limit applies before the shuffle."""
    w = Window.partitionBy("family").orderBy(F.desc("occurrences"), F.desc_nulls_last(F.coalesce("last_seen", "created_at")), "statement", "record_id")
    return register.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pilot_counts(records: DataFrame) -> DataFrame:
    """Counts by stream, pattern and sensitivity as rows (dimension, value, n), from one pass."""
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("(none)")).alias("value")) for d in ("stream", "pattern_type", "sensitivity")])).alias("d")
    return records.select(dims).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def pilot_examples(records: DataFrame, patterns: int = 10, each: int = 20) -> DataFrame:
    """Up to `each` records of the `patterns` most frequent patterns, internal ones first, then by confidence and id."""
    top = records.groupBy("stream", "pattern_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stream", "pattern_type").limit(patterns)
    w = Window.partitionBy("stream", "pattern_type").orderBy(F.when(F.col("sensitivity") == "internal", 0).otherwise(1), F.desc_nulls_last("confidence"), "record_id")
    return records.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).join(F.broadcast(top.drop("n")), ["stream", "pattern_type"], "left_semi")


def shown_quotes(records: DataFrame, quote: str = "quote", chars: int = 700) -> DataFrame:
    """Quotes as a report shows them: those of rows that aren't internal are suppressed, others masked and cut."""
    safe = F.substring(masked(F.col(quote))["text"], 1, chars)
    return records.withColumn("shown", F.when(F.col("sensitivity") == "internal", safe).otherwise("[suppressed]"))


def findings_markdown(top: DataFrame, totals: dict[str, int]) -> str:
    """Report of the top findings. `top` is bounded by families times k."""
    lines = ["# Findings", "", f"Rows: {totals.get('rows', 0)}; occurrences: {totals.get('occurrences', 0)}", ""]
    family = None
    for r in top.orderBy("family", "rank").toLocalIterator():
        if r["family"] != family:
            family = r["family"]
            lines += [f"## {family}", ""]
        lines.append(f"- ({r['occurrences']}x) {r['statement']}")
    return "\n".join(lines) + "\n"


def pilot_markdown(records: DataFrame, patterns: int = 20) -> str:
    """Report of the rule-based records: counts by stream, pattern and sensitivity, and examples of the most frequent patterns. All lists are bounded."""
    lines = ["# Pilot", "", "| dimension | value | records |", "|-|-|-|"]
    lines += [f"| {r.dimension} | {r.value} | {r.n} |" for r in pilot_counts(records).orderBy("dimension", F.desc("n"), "value").limit(3 * patterns).collect()]
    pattern = None
    first = pilot_examples(records).withColumn("quote", F.try_element_at("evidence", F.lit(1))["quote"])
    for r in shown_quotes(first).orderBy("stream", "pattern_type", "rank").toLocalIterator():
        if (r["stream"], r["pattern_type"]) != pattern:
            pattern = (r["stream"], r["pattern_type"])
            lines += ["", f"## {pattern[0]}: {pattern[1]}", ""]
        lines.append(f"- {r['summary']} — {r['shown']}")
    return "\n".join(lines) + "\n"


def scorecard_markdown(result: dict) -> str:
    """Scorecard of a candidate run (`plans.benchmark.run_candidate`)."""
    rows = result["runs"].orderBy("run", "level", "bucket").collect()
    out = ["# Scorecard", "", f"windows of {result['window_params'][0]} tokens, overlap {result['window_params'][1]}", "", "| run | level | bucket | matched | gold | found | recall | 95% interval | agreement | 95% interval | f1 |", "|-|-|-|-|-|-|-|-|-|-|-|"]
    out += [f"| {r.run} | {r.level} | {r.bucket} | {r.matched} | {r.gold} | {r.candidates} | {r.recall:.3f} | [{r.recall_low:.3f}, {r.recall_high:.3f}] | {r.agreement:.3f} | [{r.agreement_low:.3f}, {r.agreement_high:.3f}] | {r.f1:.3f} |" for r in rows]
    out += ["", *[f"- mean {m}: {v['mean']:.3f} (deviation {v['sd']:.3f})" for m, v in result["summary"].items()]]
    out += [f"- run {r.run}: {r.passes} passes, errors {r.error_rate:.3f}, valid JSON {r.valid_json_rate:.3f}" for r in result["transport"].orderBy("run").collect()]
    if "recall_pass" in result:
        out.append(f"- recall reaches the threshold: {'yes' if result['recall_pass'] else 'no'}")
    out += ["", "Agreement is measured against the gold set only, so a finding that is right but not in it counts against it. Intervals are wide for small gold sets.", "Code level matches by session and code; quote level also needs four words in a row."]
    return "\n".join(out) + "\n"
