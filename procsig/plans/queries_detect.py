"""Bound queries: scaler and z-score detector (A21, D1-D5) on the events series."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.functions.scalar import tier
from procsig.operators import detect as dt
from procsig.plans.bound import E_FEATS, THRESHOLD, events_features, events_scored, events_scored_sql
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import q

_SQL = events_scored_sql()


def _long(parts):
    return "\nUNION ALL\n".join(parts)


@register("column_moments", _SQL + "\n" + _long(
    f"SELECT '{f}' AS feature, round({q(f + '__m')}, 6) AS mean, round({q(f + '__s')}, 6) AS std FROM fit"
    for f in E_FEATS))
def column_moments(spark, sf):
    feats = events_features(spark, sf).filter(F.col("split") == "train")
    return rounded(dt.moments_long(dt.column_moments(feats, E_FEATS), E_FEATS), 6)


@register("standardise", _SQL + f"""
SELECT user_id, event_id, {', '.join(f"round(({q(f)} - {q(f + '__m')}) / {q(f + '__sd')}, 6) AS {q(f)}" for f in E_FEATS)}
FROM feats, fit""")
def standardise(spark, sf):
    s = events_scored(spark, sf)
    return rounded(dt.standardise(s.feats, s.scaler).select("user_id", "event_id", *E_FEATS), 6)


@register("zscore_fit", _SQL + "\n" + _long(
    f"SELECT '{f}' AS feature, round({q(f + '__zm')}, 6) AS mean, round({q(f + '__zs')}, 6) AS std FROM fit"
    for f in E_FEATS))
def zscore_fit(spark, sf):
    feats = events_features(spark, sf)
    scaler = dt.fit_scaler(feats.filter(F.col("split") == "train"), E_FEATS)
    x = dt.standardise(feats.filter(F.col("split") == "train"), scaler)
    fit = dt.zscore_fit_df(x, E_FEATS, normal=~F.col("label"))
    return rounded(dt.moments_long(fit, E_FEATS), 6)


@register("zscore_predict", _SQL + "\nSELECT user_id, event_id, prediction FROM scored")
def zscore_predict(spark, sf):
    s = events_scored(spark, sf)
    return dt.zscore_score(dt.standardise(s.feats, s.scaler), s.zmodel, THRESHOLD).select(
        "user_id", "event_id", "prediction")


@register("zscore_proba", _SQL + """
SELECT user_id, event_id, round(max_z, 6) AS max_z, round(1 - confidence, 6) AS p_normal,
       round(confidence, 6) AS p_anomaly FROM scored""")
def zscore_proba(spark, sf):
    s = events_scored(spark, sf)
    out = dt.zscore_score(dt.standardise(s.feats, s.scaler), s.zmodel, THRESHOLD)
    return rounded(out.select("user_id", "event_id", "max_z", (1 - F.col("confidence")).alias("p_normal"),
                              F.col("confidence").alias("p_anomaly")), 6)


@register("zscore_importance", _SQL + """
, inv AS (""" + _long(f"SELECT '{f}' AS feature, 1.0 / abs({q(f + '__zs')}) AS v FROM fit" for f in E_FEATS) + """)
SELECT feature, round(v / sum(v) OVER (), 8) AS importance FROM inv""")
def zscore_importance(spark, sf):
    feats = events_features(spark, sf)
    scaler = dt.fit_scaler(feats.filter(F.col("split") == "train"), E_FEATS)
    x = dt.standardise(feats.filter(F.col("split") == "train"), scaler)
    fit = dt.zscore_fit_df(x, E_FEATS, normal=~F.col("label"))
    return rounded(dt.zscore_importance_df(fit, E_FEATS), 8)


@register("feature_chain_scored", _SQL + f"""
SELECT user_id, event_id, sample, split, round(max_z, 6) AS max_z, prediction, round(confidence, 6) AS confidence,
       CASE WHEN confidence >= 0.75 THEN 'ALERT' WHEN confidence >= 0.5 THEN 'CAUTION' ELSE 'NORMAL' END AS tier
FROM scored""")
def feature_chain_scored(spark, sf):
    s = events_scored(spark, sf).scored
    return rounded(s.select("user_id", "event_id", "sample", "split", "max_z", "prediction", "confidence",
                            tier("confidence").alias("tier")), 6)
