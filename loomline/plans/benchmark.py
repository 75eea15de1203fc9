"""A candidate extractor run over a frozen benchmark and scored against its gold set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import constants as C
from loomline.operators import prompts, scoring, validate, windows
from loomline.plans.cycle import prepare
from loomline.plans.model import Chat, call_model
from loomline.session import cut_lineage


def window_params(manifest: DataFrame, limit: int | None = None, overlap: int | None = None) -> tuple[int, int]:
    """Window sizes: those given, else the manifest's, else the defaults. A limit of 0 counts as none, an overlap of 0 is meant."""
    stated = manifest.select("window_params.*").first().asDict() if "window_params" in manifest.columns else {}
    first = lambda *xs: next((x for x in xs if x is not None), None)
    return limit or stated.get("max_window_tokens") or C.MAX_WINDOW_TOKENS, first(overlap, stated.get("overlap_tokens"), C.OVERLAP_TOKENS)


def predictions(turns: DataFrame, chat: Chat, heads: dict[str, str], limit: int, overlap: int, strategy: str = "per_family") -> tuple[DataFrame, DataFrame]:
    """(accepted findings (session_id, ord, code, quote), passes (session_id, window_id, family, status, valid_json, rejected)).

    Quotes may come from any turn of the session: as it was shown in the window, else as it is.
    """
    wins, mem = prepare(turns, limit, overlap)
    plan = cut_lineage(windows.planned(wins, strategy))
    bundles = prompts.bundles(mem, plan, heads, text="shown").join(plan.select("window_id", "session_id", "window_index", "family"), ["session_id", "window_index", "family"])
    answers = cut_lineage(call_model(bundles, chat))
    ids = plan.select("window_id", "session_id", "window_index").distinct()
    shown = mem.join(ids, ["session_id", "window_index"]).select("window_id", "turn_id", "shown")
    every = ids.join(turns.select("session_id", "turn_id", "idx", "actor", "text"), "session_id")
    surface = every.join(shown, ["window_id", "turn_id"], "left").select("window_id", "turn_id", "idx", "actor", F.coalesce("shown", "text", F.lit("")).alias("shown"))
    judged = cut_lineage(validate.validated(answers.where("payload IS NOT NULL").select("window_id", "family", "payload"), surface))
    ok = judged.where("reason IS NULL").join(answers.select("window_id", "family", "session_id", "window_index"), ["window_id", "family"])
    order = F.concat_ws("/", F.lpad(F.col("window_index").cast("string"), 12, "0"), "family", F.lpad(F.col("position").cast("string"), 6, "0"))
    found = ok.select("session_id", order.alias("ord"), F.col("codebook_code").alias("code"), F.try_element_at("resolved", F.lit(1))["quote"].alias("quote"))
    rejected = judged.groupBy("window_id", "family").agg(F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    passes = answers.join(rejected, ["window_id", "family"], "left").select("session_id", "window_id", "family", F.when(F.col("error").isNull(), "processed").otherwise("error").alias("status"), F.col("payload").isNotNull().alias("valid_json"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
    return found, passes


def scored(gold: DataFrame, found: DataFrame, sessions: DataFrame) -> DataFrame:
    """(level, bucket, scores): code level in total and by bucket, and quote-strict in total."""
    gold, found = (d.select("session_id", "code", "quote", F.col("ord").cast("string").alias("ord")) for d in (gold, found))
    code = scoring.matched_counts(gold, found).join(sessions.select("session_id", "bucket"), "session_id", "left")
    name = lambda d, level, bucket: d.select(F.lit(level).alias("level"), bucket.alias("bucket"), *[c for c in d.columns if c != "bucket"])
    return name(scoring.scores(code), "code", F.lit("all")).unionByName(name(scoring.scores(code, "bucket"), "code", F.col("bucket"))).unionByName(name(scoring.scores(scoring.strict_counts(gold, found)), "quote", F.lit("all")))


def run_candidate(data: dict[str, DataFrame], chat: Chat, *, runs: int = 3, limit: int | None = None, overlap: int | None = None, strategy: str = "per_family", threshold: float | None = None, codebook: str = prompts.CODEBOOK) -> dict:
    """Check the benchmark, run the candidate `runs` times and score each run.

    `data` comes from `sources.transcripts.benchmark`. The result has DataFrames `runs` (run, level, bucket, scores), `passes`, `transport`
    and `baseline`, the means and deviations over runs as `summary`, the window sizes, and with a threshold `recall_pass`: whether there is
    gold and mean recall on code level reaches it.
    """
    if runs < 1:
        raise ValueError("one run or more")
    manifest, sessions, turns, gold = (data[k] for k in ("manifest", "sessions", "turns", "gold"))
    evidence = gold.select(F.explode("evidence").alias("e")).select("e.turn_id", "e.quote")
    totals = manifest.select("totals.*").first().asDict() if "totals" in manifest.columns else None
    scoring.assert_integrity(evidence, turns, totals, {"sessions": sessions, "turns": turns, "gold_findings": gold, "baseline_findings": data["baseline"]})
    sizes = window_params(manifest, limit, overlap)
    heads = prompts.heads(prompts.codebook(sessions.sparkSession, codebook))
    made = [(k, *predictions(turns, chat, heads, *sizes, strategy)) for k in range(1, runs + 1)]
    stack = lambda ds: cut_lineage(reduce(DataFrame.unionByName, ds))
    scores = stack([scored(gold, found, sessions).withColumn("run", F.lit(k)) for k, found, _ in made])
    passes = stack([p.withColumn("run", F.lit(k)) for k, _, p in made])
    code = scores.where("level = 'code' AND bucket = 'all'")
    out = {
        "runs": scores, "passes": passes, "transport": scoring.transport(passes, "run"), "baseline": scored(gold, data["baseline"], sessions), "window_params": sizes,
        "summary": {m: scoring.mean_sd(code, m).first().asDict() for m in ("recall", "agreement", "f1")},
    }
    if threshold is not None:
        out["recall_pass"] = code.agg(F.max("gold")).first()[0] > 0 and out["summary"]["recall"]["mean"] >= threshold
    return out
