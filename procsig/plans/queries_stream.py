"""Bound query: streaming scorer (X1) over the events files, same result as the batch chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.functions.scalar import cache_key_sql, percent_text_sql
from procsig.plans.bound import E_FEATS, THRESHOLD, events_scored, events_scored_sql
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import q
from procsig.sources.tables import VARIABLE_DESCRIPTIONS, table
from procsig.streaming.scorer import run_to_table

_NAME = VARIABLE_DESCRIPTIONS["value"]
_PCT = percent_text_sql("confidence")


@register("stream_scores", events_scored_sql() + f"""
, t AS (SELECT *, {' + '.join(f"({q(f + '__z')} - {THRESHOLD})" for f in E_FEATS)} AS total,
               CASE WHEN confidence >= 0.75 THEN 'ALERT' WHEN confidence >= 0.5 THEN 'CAUTION' ELSE 'NORMAL' END AS tier FROM scored)
SELECT user_id, event_id, round(max_z, 6) AS max_z, prediction, round(confidence, 6) AS confidence, tier,
       'value' AS top1_variable, round(total, 4) AS top1_score,
       CASE WHEN tier = 'NORMAL' THEN 'NORMAL: ' || {_PCT} || ' anomaly probability'
            ELSE tier || ': ' || {_PCT} || ' confidence - key factors: {_NAME}' END AS context,
       {cache_key_sql('confidence', f"CASE WHEN confidence >= 0.5 THEN ['{_NAME}'] ELSE []::VARCHAR[] END")} AS cache_key
FROM t""")
def stream_scores(spark, sf):
    s = events_scored(spark, sf)
    out = run_to_table(spark, table(spark, sf, "events"), s.scaler, s.zmodel, THRESHOLD, descriptions=VARIABLE_DESCRIPTIONS)
    top = F.col("important_features")[0]
    out = out.select("user_id", "event_id", "max_z", "prediction", "confidence", "tier", top["variable_name"].alias("top1_variable"),
                     top["importance_score"].alias("top1_score"), "context", "cache_key")
    return rounded(out, {"top1_score": 4, "*": 6})
