"""Token usage and cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline import constants as C


def normalised(usage: Column) -> Column:
    """Struct of token counts from a usage object as JSON, in either of the two shapes providers use.

    A missing total is the sum of its parts; missing reasoning tokens are what the total has beyond the others. Null where nothing is stated.
    """
    num = lambda *paths: F.coalesce(*[F.get_json_object(usage, f"$.{p}").try_cast("long") for p in paths], F.lit(0).cast("long"))
    prompt, completion = num("prompt_tokens", "input_tokens"), num("completion_tokens", "output_tokens")
    cached = num("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens")
    reasoning = num("completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens", "reasoning_tokens")
    ticks = F.get_json_object(usage, "$.cost_in_usd_ticks").try_cast("long")
    stated = num("total_tokens")
    total = F.when(stated == 0, prompt + completion + reasoning).otherwise(stated)
    extra = F.when((reasoning == 0) & (total > prompt + completion), total - prompt - completion).otherwise(reasoning)
    some = (prompt + completion + reasoning + cached + stated > 0) | ticks.isNotNull()
    return F.when(some, F.struct(prompt.alias("prompt"), completion.alias("completion"), extra.alias("reasoning"), cached.alias("cached"), total.alias("total"), ticks.alias("ticks")))


def costs(calls: DataFrame, *by: str) -> DataFrame:
    """Cost of calls (model, prompt, completion, reasoning, total, ticks) by columns.

    Exact from ticks, estimated from list prices, effective the larger; the source says
    whether all, some or none of the calls were priced.
    """
    s = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    t = calls.groupBy(*by, "model").agg(F.count("*").alias("calls"), F.count("ticks").alias("priced"), s("prompt").alias("prompt"), s("completion").alias("completion"), s("reasoning").alias("reasoning"), s("total").alias("total"), s("ticks").alias("ticks"))
    out = F.greatest(F.col("completion") + F.col("reasoning"), F.col("total") - F.col("prompt"))
    estimate = F.lit(None).cast("double")
    for model, (i, o) in C.PRICES.items():
        estimate = F.when((F.col("model") == model) & (F.col("prompt") + F.col("completion") + F.col("reasoning") > 0), (F.col("prompt") * i + out * o) / 1_000_000).otherwise(estimate)
    exact = F.when(F.col("priced") > 0, F.col("ticks") / float(C.TICKS_PER_USD))
    source = F.when(F.col("priced") == F.col("calls"), "exact").when(F.col("priced") > 0, "partial").when(estimate.isNotNull(), "estimated").otherwise("unavailable")
    return t.select(*by, "model", "calls", "priced", "prompt", "completion", "reasoning", "total", F.round(exact, 6).alias("exact_usd"), F.round(estimate, 6).alias("estimated_usd"), F.round(F.greatest(exact, estimate), 6).alias("effective_usd"), source.alias("cost_source"))
