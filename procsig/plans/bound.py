"""Shared bound pipelines (Spark) and their SQL counterparts for the oracle.

``events_scored``: events -> sample -> serving features on ``value`` -> series holdout split
-> scaler on training rows -> z-score on normal training rows -> max |z|, prediction,
confidence. The SQL builder writes the same computation as CTEs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.functions.scalar import ZERO_STD_GUARD
from procsig.operators import features as fe
from procsig.operators.detect import Moments, fit_scaled_zscore, z_exprs
from procsig.operators.prepare import holdout_cut, holdout_split
from procsig.plans.sqlgen import complete, feature_sql, q, win
from procsig.sources.tables import EVENTS, table

THRESHOLD = 3.0
TRAIN_FRACTION = 0.8
E_VARS = ["value"]
E_FEATS = fe.feature_names(E_VARS)


@dataclass
class Scored:
    feats: DataFrame          # features of complete rows + split + label
    scaler: Moments
    zmodel: Moments
    scored: DataFrame         # feats + max_z, prediction, confidence


def events_features(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", EVENTS.label.alias("label"))
    s = fe.with_sample_number(EVENTS.spec.drop_null_keys(ev), EVENTS.spec, chunks="auto")
    feats = fe.feature_chain_serving(s, EVENTS.spec, E_VARS, chunks="auto")
    return holdout_split(feats, "user_id", TRAIN_FRACTION,
                         cut=holdout_cut(table(spark, sf, "events"), "user_id", TRAIN_FRACTION))


def events_scored(spark: SparkSession, sf: str, threshold: float = THRESHOLD) -> Scored:
    feats = events_features(spark, sf)
    scaler, zmodel = fit_scaled_zscore(feats.filter(F.col("split") == "train"), E_FEATS, ~F.col("label"))
    zs = z_exprs(zmodel, scaler)
    mz = F.greatest(*zs.values())
    scored = feats.select("*", mz.alias("max_z")).select(
        "*", (F.col("max_z") > F.lit(threshold)).cast("int").alias("prediction"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("max_z") - F.lit(threshold))))).alias("confidence"))
    return Scored(feats, scaler, zmodel, scored)


# ----------------------------------------------------------------- SQL side

def events_scored_sql(threshold: float = THRESHOLD) -> str:
    """CTEs ``feats`` (complete rows + split), ``fit`` (one row) and ``scored``."""
    w = win(EVENTS)
    cols = ["user_id", "ts", "event_id"] + E_FEATS
    fit_parts, std_parts, z_parts = [], [], []
    for f in E_FEATS:
        fit_parts += [f"avg({q(f)}) AS {q(f + '__m')}", f"stddev_pop({q(f)}) AS {q(f + '__s')}",
                      f"avg(CASE WHEN NOT label THEN {q(f)} END) AS {q(f + '__nm')}",
                      f"stddev_pop(CASE WHEN NOT label THEN {q(f)} END) AS {q(f + '__ns')}"]
        s = f"CASE WHEN {q(f + '__s')} IS NULL OR {q(f + '__s')} = 0 THEN 1.0::DOUBLE ELSE {q(f + '__s')} END"
        std_parts.append(f"{s} AS {q(f + '__sd')}")
        z_parts.append(f"abs((({q(f)} - {q(f + '__m')}) / {q(f + '__sd')} - {q(f + '__zm')}) / {q(f + '__zs')}) AS {q(f + '__z')}")
    zmodel = []
    for f in E_FEATS:
        zmodel += [f"({q(f + '__nm')} - {q(f + '__m')}) / {q(f + '__sd')} AS {q(f + '__zm')}",
                   f"CASE WHEN {q(f + '__ns')} / {q(f + '__sd')} = 0 THEN {ZERO_STD_GUARD}::DOUBLE "
                   f"ELSE {q(f + '__ns')} / {q(f + '__sd')} END AS {q(f + '__zs')}"]
    greatest = "greatest(" + ", ".join(q(f + "__z") for f in E_FEATS) + ")"
    return f"""WITH base AS (
  SELECT user_id, ts, event_id, event_type = 'error' AS label, value,
         CAST(row_number() OVER ({w}) AS INTEGER) AS sample, {', '.join(feature_sql(E_VARS, w))}
  FROM events WHERE user_id IS NOT NULL),
cut AS (SELECT min(user_id) + {TRAIN_FRACTION} * (max(user_id) - min(user_id)) AS c FROM events),
feats AS (SELECT base.*, CASE WHEN user_id <= c THEN 'train' ELSE 'validation' END AS split
          FROM base, cut WHERE {complete(cols + ['label', 'sample'], E_FEATS)}),
raw AS (SELECT {', '.join(fit_parts)} FROM feats WHERE split = 'train'),
sc AS (SELECT raw.*, {', '.join(std_parts)} FROM raw),
fit AS (SELECT sc.*, {', '.join(zmodel)} FROM sc),
zrows AS (SELECT feats.*, {', '.join(z_parts)} FROM feats, fit),
scored AS (SELECT *, {greatest} AS max_z, CAST({greatest} > {threshold} AS INTEGER) AS prediction,
                  1.0::DOUBLE / (1.0 + exp(-({greatest} - {threshold}))) AS confidence FROM zrows)"""


# ----------------------------------------------------------------- lineitem analysis record

def lineitem_records(spark: SparkSession, sf: str, threshold: float = THRESHOLD, keep: tuple = (),
                     chunks: int | str = "auto") -> DataFrame:
    """R11 over lineitem: one record per (supplier, sample).

    ``chunks="auto"`` measures the largest supplier series first and switches to the
    chunked (hot-series) plan only when one series exceeds the per-task target."""
    from procsig.plans.analysis import analysis_records
    from procsig.sources.tables import LINEITEM, VARIABLE_DESCRIPTIONS
    b = LINEITEM
    raw = b.spec.drop_null_keys(b.load(spark, sf))
    if chunks == "auto":
        chunks = fe.series_chunks(raw.select(*b.keys), b.spec)
    samples = fe.with_sample_number(raw, b.spec, chunks=chunks)
    return analysis_records(samples, b.spec, list(b.variables), threshold=threshold,
                            descriptions=VARIABLE_DESCRIPTIONS, train_fraction=TRAIN_FRACTION, keep=keep,
                            chunks=chunks, cut=holdout_cut(raw, b.keys[0], TRAIN_FRACTION))


def lineitem_records_sql(threshold: float = THRESHOLD) -> str:
    """CTEs ``zr`` (every row: ok flag, z per feature, contributions), ``tot`` (base totals of ok
    rows), ``rk`` (ranked bases with descriptions) and ``rec`` (the record without texts)."""
    from procsig.sources.tables import LINEITEM, VARIABLE_DESCRIPTIONS
    b = LINEITEM
    lv = list(b.variables)
    feats = fe.feature_names(lv)
    w = win(b)
    fit_parts, std_parts, zmodel, z_parts = [], [], [], []
    for f in feats:
        fit_parts += [f"avg({q(f)}) AS {q(f + '__m')}", f"stddev_pop({q(f)}) AS {q(f + '__s')}",
                      f"avg(CASE WHEN NOT label THEN {q(f)} END) AS {q(f + '__nm')}",
                      f"stddev_pop(CASE WHEN NOT label THEN {q(f)} END) AS {q(f + '__ns')}"]
        std_parts.append(f"CASE WHEN {q(f + '__s')} IS NULL OR {q(f + '__s')} = 0 THEN 1.0::DOUBLE ELSE {q(f + '__s')} END AS {q(f + '__sd')}")
        zmodel += [f"({q(f + '__nm')} - {q(f + '__m')}) / {q(f + '__sd')} AS {q(f + '__zm')}",
                   f"CASE WHEN {q(f + '__ns')} / {q(f + '__sd')} = 0 THEN {ZERO_STD_GUARD}::DOUBLE "
                   f"ELSE {q(f + '__ns')} / {q(f + '__sd')} END AS {q(f + '__zs')}"]
        z_parts.append(f"abs((({q(f)} - {q(f + '__m')}) / {q(f + '__sd')} - {q(f + '__zm')}) / {q(f + '__zs')}) AS {q(f + '__z')}")
    seq = "coalesce(sample >= 3 AND lag(sample, 1) OVER (" + w + ") = sample - 1 AND lag(sample, 2) OVER (" + w + ") = sample - 2, false)"
    okc = " AND ".join(f"{q(f)} IS NOT NULL AND NOT isnan({q(f)})" for f in feats)
    groups = {v: [n for n in feats if n == v or n.startswith(v + "_")] for v in lv}
    tot = "\nUNION ALL\n".join(
        f"SELECT l_suppkey, sample, '{v}' AS base, {' + '.join('(' + q(f + '__z') + ' - ' + repr(threshold) + ')' for f in groups[v])} AS total FROM zr WHERE ok"
        for v in lv)
    desc = "CASE base " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in VARIABLE_DESCRIPTIONS.items()) + " END"
    greatest = "greatest(" + ", ".join(q(f + "__z") for f in feats) + ")"
    return f"""WITH s AS (
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, {', '.join(lv)}, l_returnflag = 'R' AS label,
         CAST(row_number() OVER ({w}) AS INTEGER) AS sample
  FROM lineitem WHERE l_suppkey IS NOT NULL),
f AS (SELECT s.*, {', '.join(feature_sql(lv, w))}, {seq} AS seq_ok FROM s),
cut AS (SELECT min(l_suppkey) + {TRAIN_FRACTION} * (max(l_suppkey) - min(l_suppkey)) AS c FROM lineitem),
fs AS (SELECT f.*, CASE WHEN l_suppkey <= c THEN 'train' ELSE 'validation' END AS split,
              seq_ok AND {okc} AS ok FROM f, cut),
raw AS (SELECT {', '.join(fit_parts)} FROM fs WHERE ok AND split = 'train'),
sc AS (SELECT raw.*, {', '.join(std_parts)} FROM raw),
fit AS (SELECT sc.*, {', '.join(zmodel)} FROM sc),
zr AS (SELECT fs.*, {', '.join(z_parts)} FROM fs, fit),
tot AS ({tot}),
rk AS (SELECT *, {desc} AS description,
              CAST(row_number() OVER (PARTITION BY l_suppkey, sample ORDER BY total DESC, base) AS INTEGER) AS rank FROM tot),
top AS (SELECT l_suppkey, sample,
               max(CASE WHEN rank = 1 THEN base END) AS top1_variable, max(CASE WHEN rank = 1 THEN total END) AS top1_score,
               max(CASE WHEN rank = 2 THEN base END) AS top2_variable, max(CASE WHEN rank = 2 THEN total END) AS top2_score,
               max(CASE WHEN rank = 3 THEN base END) AS top3_variable, max(CASE WHEN rank = 3 THEN total END) AS top3_score,
               max(CASE WHEN rank = 1 THEN description END) AS d1, max(CASE WHEN rank = 2 THEN description END) AS d2,
               max(CASE WHEN rank = 3 THEN description END) AS d3
        FROM rk WHERE rank <= 3 GROUP BY l_suppkey, sample),
rec0 AS (SELECT zr.l_suppkey, zr.sample, zr.label, zr.split, zr.l_shipdate,
                CASE WHEN ok THEN 'OK' ELSE 'ERROR' END AS status,
                CASE WHEN ok THEN {greatest} END AS max_z,
                CASE WHEN ok THEN CAST({greatest} > {threshold} AS INTEGER) END AS prediction,
                CASE WHEN ok THEN 1.0::DOUBLE / (1.0 + exp(-({greatest} - {threshold}))) END AS confidence
         FROM zr),
rec AS (SELECT rec0.*, top.top1_variable, top.top1_score, top.top2_variable, top.top2_score,
               top.top3_variable, top.top3_score, d1, d2, d3,
               CASE WHEN confidence >= 0.75 THEN 'ALERT' WHEN confidence >= 0.5 THEN 'CAUTION' WHEN confidence IS NOT NULL THEN 'NORMAL' END AS tier
        FROM rec0 LEFT JOIN top ON rec0.l_suppkey = top.l_suppkey AND rec0.sample = top.sample)"""
