"""Alert report.

The reference builds one explanation per request through an external text service and a
process-local cache. Here every scored row gets a context line and a templated explanation
as column expressions; external answers arrive as a table ``(cache_key, response)`` that is
joined back, and the work list of keys still to ask for is a grouped aggregation.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsig.functions.scalar import (REQUIRED_FIELDS, action_line, cache_key, contains_all,
                                      percent_text, tier)

# Default explanation texts per tier (our own wording). Users pass their own mapping.
DEFAULT_TEMPLATES = {
    "ALERT": ("STATUS: ALERT\n"
              "ISSUE: Strong deviation from the normal operating profile\n"
              "ROOT CAUSE: Not determined automatically - inspect the listed variables\n"
              "IMMEDIATE ACTION: Inspect the listed variables and their upstream units\n"
              "MONITORING: Every variable named in the alert"),
    "CAUTION": ("STATUS: CAUTION\n"
                "ISSUE: Moderate deviation from the normal operating profile\n"
                "ROOT CAUSE: Not determined automatically - confirm on site\n"
                "IMMEDIATE ACTION: Compare the listed variables with their recent trend\n"
                "MONITORING: Trend of the listed variables"),
    "NORMAL": "STATUS: NORMAL - no action needed; keep routine monitoring.",
}


def descriptions_of(features: Column) -> Column:
    """Descriptions of an important-features array (NULL descriptions fall back to the name)."""
    return F.transform(features, lambda x: F.coalesce(x["description"], x["variable_name"]))


def context_line(conf: str | Column, features: str | Column) -> Column:
    """Tier, percent confidence and, from CAUTION up, the ', '-joined factor descriptions."""
    conf = F.col(conf) if isinstance(conf, str) else conf
    feats = F.col(features) if isinstance(features, str) else features
    t = tier(conf)
    pct = percent_text(conf)
    factors = F.array_join(descriptions_of(feats), ", ")
    return (F.when(t == "NORMAL", F.concat(F.lit("NORMAL: "), pct, F.lit(" anomaly probability")))
            .otherwise(F.concat(t, F.lit(": "), pct, F.lit(" confidence - key factors: "), factors)))


def template_text(tier_col: Column, templates: Mapping[str, str] = DEFAULT_TEMPLATES) -> Column:
    """Templated explanation per tier."""
    expr = None
    for k, v in templates.items():
        expr = F.when(tier_col == k, F.lit(v)) if expr is None else expr.when(tier_col == k, F.lit(v))
    return expr


def with_alert_text(df: DataFrame, conf: str = "confidence", features: str = "important_features",
                    templates: Mapping[str, str] = DEFAULT_TEMPLATES) -> DataFrame:
    """R4 + R5 + F14: tier, context, template explanation and cache key columns."""
    t = tier(F.col(conf))
    descs = F.when(F.col(conf) >= 0.5, descriptions_of(F.col(features))).otherwise(F.array().cast("array<string>"))
    return df.select(
        "*",
        t.alias("tier"),
        context_line(conf, features).alias("context"),
        template_text(t, templates).alias("template"),
        cache_key(F.col(conf), descs).alias("cache_key"),
    )


def response_check(responses: DataFrame, text: str = "response") -> DataFrame:
    """Flag responses that carry all five section labels."""
    return responses.select("*", contains_all(F.col(text), REQUIRED_FIELDS).alias("is_valid"))


def valid_responses(responses: DataFrame) -> DataFrame:
    """Cache content: one valid response per key (invalid answers are never cached).

    ``min_by`` aggregation, so a key repeated a billion times is pre-aggregated map-side.
    """
    checked = response_check(responses)
    return (checked.filter("is_valid").groupBy("cache_key")
            .agg(F.min_by(F.trim(F.col("response")), F.col("response")).alias("response")))


def resolve_explanation(analyses: DataFrame, responses: DataFrame) -> DataFrame:
    """External response when valid, else the template; R9 action line from the result.

    The cache side has one row per distinct key; Spark chooses broadcast or shuffle join
    from its size (AQE re-plans at run time).
    """
    cache = valid_responses(responses)
    joined = analyses.join(cache, "cache_key", "left")
    explanation = F.coalesce(F.col("response"), F.col("template"))
    return joined.select(*[F.col(c) for c in analyses.columns],
                         explanation.alias("explanation"),
                         F.col("response").isNotNull().alias("from_cache"),
                         action_line(explanation).alias("action"))


def worklist(analyses: DataFrame, responses: DataFrame | None, order: str | Column = "seq") -> DataFrame:
    """One entry per cache key not yet answered, represented by its earliest analysis."""
    order = F.col(order) if isinstance(order, str) else order
    first = (analyses.groupBy("cache_key")
             .agg(F.min_by(F.struct(*[F.col(c) for c in analyses.columns if c != "cache_key"]), order)
                  .alias("_first"), F.count(F.lit(1)).alias("n_requests")))
    first = first.select("cache_key", "_first.*", "n_requests")
    if responses is not None:
        first = first.join(valid_responses(responses).select("cache_key"), "cache_key", "left_anti")
    return first


def history_window(df: DataFrame, series: list[str], order: str, item: Column, k: int = 3,
                   chunks: int | str = 1) -> DataFrame:
    """The previous k items of the same series (bounded frame, at most k per row).

    ``chunks > 1`` spreads big series over ordered ranges with k halo rows (same result).
    """
    from procsig.operators.features import windowed
    from procsig.spec import SeriesSpec

    def build(s: SeriesSpec):
        return [F.collect_list(item).over(s.frame(-k, -1)).alias("history")]

    spec = SeriesSpec(tuple(series), (order,))
    return windowed(df, spec, k, build, chunks)


def history_line(ts: Column, conf: Column, features: Column, action: Column) -> Column:
    """``Time: HH:mm | Confidence: x% | Features: a, b | Action taken: ...``."""
    names = F.array_join(F.transform(features, lambda x: x["variable_name"]), ", ")
    return F.concat(F.lit("Time: "), F.date_format(ts, "HH:mm"), F.lit(" | Confidence: "), percent_text(conf),
                    F.lit(" | Features: "), names, F.lit(" | Action taken: "), action)
