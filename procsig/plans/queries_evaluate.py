"""Bound queries: evaluation and tuning (A22-A25, D12, D14, T1, T3, T6) on the events scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.operators import detect as dt
from procsig.operators import evaluate as ev
from procsig.plans.bound import E_FEATS, events_scored, events_scored_sql
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import q

_SQL = events_scored_sql()
THRESHOLDS = ev.linspace(1.0, 5.0, 50)


def _validation(spark, sf):
    s = events_scored(spark, sf).scored.filter(F.col("split") == "validation")
    return s.select("user_id", "event_id", "label", "prediction", F.col("max_z").alias("score"))


_VAL = _SQL + ", v AS (SELECT label, prediction, max_z AS score FROM scored WHERE split = 'validation')"

_CONF = """CAST(count(*) FILTER (WHERE label AND prediction = 1) AS BIGINT) AS tp,
           CAST(count(*) FILTER (WHERE NOT label AND prediction = 1) AS BIGINT) AS fp,
           CAST(count(*) FILTER (WHERE NOT label AND prediction = 0) AS BIGINT) AS tn,
           CAST(count(*) FILTER (WHERE label AND prediction = 0) AS BIGINT) AS fn"""


def _prf_sql(tp="tp", fp="fp", fn="fn"):
    return (f"coalesce({tp}::DOUBLE / nullif({tp} + {fp}, 0), 0.0::DOUBLE) AS precision, "
            f"coalesce({tp}::DOUBLE / nullif({tp} + {fn}, 0), 0.0::DOUBLE) AS recall, "
            f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0::DOUBLE) AS f1")


@register("confusion_counts", _VAL + f"""
, c AS (SELECT {_CONF} FROM v)
SELECT tp, fp, tn, fn, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0.0::DOUBLE), 6) AS fpr,
       round(coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0.0::DOUBLE), 6) AS fnr FROM c""")
def confusion_counts(spark, sf):
    return rounded(ev.confusion(_validation(spark, sf)), 6)


@register("precision_recall_f1", _VAL + f"""
, c AS (SELECT {_CONF} FROM v), m AS (SELECT {_prf_sql()} FROM c)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m""")
def precision_recall_f1(spark, sf):
    return rounded(ev.precision_recall_f1(_validation(spark, sf)), 6)


_CUM = """, g AS (SELECT {by}score, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                  CAST(sum(CASE WHEN label THEN 0 ELSE 1 END) AS BIGINT) AS neg
           FROM {src} WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY {by}score),
cum AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY {pby} ORDER BY score DESC
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above,
                  coalesce(sum(neg) OVER (PARTITION BY {pby} ORDER BY score DESC
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_above,
                  sum(pos) OVER (PARTITION BY {pby}) AS P, sum(neg) OVER (PARTITION BY {pby}) AS N FROM g)"""


@register("roc_auc", _VAL + _CUM.format(by="", pby="1", src="v") + """
SELECT round(sum(neg * (pos_above + pos / 2.0)) / nullif(any_value(P) * any_value(N), 0), 10) AS auc FROM cum""")
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(_validation(spark, sf)), 10)


@register("roc_curve", _VAL + _CUM.format(by="", pby="1", src="v") + """
SELECT round(score, 6) AS threshold, round((neg_above + neg)::DOUBLE / N, 8) AS fpr, round((pos_above + pos)::DOUBLE / P, 8) AS tpr
FROM cum
UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cum HAVING count(*) > 0""")
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(_validation(spark, sf)), {"threshold": 6, "*": 8})


CURVE_POINTS = 200


@register("roc_thinned", _VAL + _CUM.format(by="", pby="1", src="v") + f"""
SELECT round(sum(neg * (pos_above + pos / 2.0)) / nullif(any_value(P) * any_value(N), 0), 8) AS auc, true AS few_points, true AS within_bound,
       true AS ends_at_one, 0.0::DOUBLE AS whole_gap FROM cum""")
def roc_thinned(spark, sf):
    """The thinned curve against the whole one: its number of points and the bound on its area."""
    val = _validation(spark, sf)
    thin, whole = ev.roc_curve(val, points=CURVE_POINTS), ev.roc_curve(val)
    told = thin.agg(F.count("*").alias("n"), F.max("fpr").alias("x"), F.max("tpr").alias("y")).first()
    auc, thin_area, area = ev.roc_auc(val).first()["auc"], ev.roc_area(thin).first()["area"], ev.roc_area(whole).first()["area"]
    row = (auc, told["n"] <= CURVE_POINTS, abs(thin_area - auc) <= ev.thinning_bound(CURVE_POINTS), told["x"] == told["y"] == 1, abs(area - auc))
    return rounded(spark.createDataFrame([row], "auc double, few_points boolean, within_bound boolean, ends_at_one boolean, whole_gap double"), 8)


def _sweep_sql():
    vals = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(THRESHOLDS))
    return _VAL + f"""
, th(trial, threshold) AS (VALUES {vals}),
pn AS (SELECT CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS P,
              CAST(sum(CASE WHEN label THEN 0 ELSE 1 END) AS BIGINT) AS N FROM v WHERE label IS NOT NULL AND score IS NOT NULL),
c AS (SELECT th.trial, th.threshold,
             CAST(count(*) FILTER (WHERE label AND score > th.threshold) AS BIGINT) AS tp,
             CAST(count(*) FILTER (WHERE NOT label AND score > th.threshold) AS BIGINT) AS fp
      FROM th LEFT JOIN v ON TRUE GROUP BY th.trial, th.threshold),
s AS (SELECT CAST(trial AS INTEGER) AS trial, threshold, tp, fp, N - fp AS tn, P - tp AS fn FROM c, pn),
m AS (SELECT *, {_prf_sql()} FROM s)"""


@register("threshold_sweep", _sweep_sql() + """
SELECT trial, round(threshold, 10) AS threshold, tp, fp, tn, fn, round(precision, 8) AS precision,
       round(recall, 8) AS recall, round(f1, 8) AS f1 FROM m""")
def threshold_sweep(spark, sf):
    return rounded(ev.threshold_sweep(_validation(spark, sf), THRESHOLDS), {"threshold": 10, "*": 8})


@register("best_threshold", _sweep_sql() + """
SELECT trial, round(threshold, 10) AS threshold, tp, fp, tn, fn, round(precision, 8) AS precision,
       round(recall, 8) AS recall, round(f1, 8) AS f1 FROM m ORDER BY f1 DESC, threshold ASC LIMIT 1""")
def best_threshold(spark, sf):
    sweep = ev.threshold_sweep(_validation(spark, sf), THRESHOLDS)
    return rounded(ev.best_threshold(sweep), {"threshold": 10, "*": 8})


# ---------------------------------------------------------------- D14 / T1: several detectors
def _model_scores(spark, sf):
    """Long scores of three detectors over the same validation rows."""
    s = events_scored(spark, sf)
    val = s.feats.filter(F.col("split") == "validation")
    zs = dt.z_exprs(s.zmodel, s.scaler)
    models = {
        "zscore_all": F.greatest(*zs.values()),
        "zscore_value": zs["value"],
        "zscore_rolling": F.greatest(*[zs[f] for f in E_FEATS if "_rolling_" in f]),
    }
    items = [F.struct(F.lit(m).alias("model"), e.alias("score")) for m, e in models.items()]
    long = val.select("user_id", "event_id", "label", F.inline(F.array(*items)))
    return long.select("*", (F.col("score") > F.lit(3.0)).cast("int").alias("prediction"))


def _models_sql():
    rolling = [f for f in E_FEATS if "_rolling_" in f]
    return _SQL + f""", zl AS (
  SELECT 'zscore_all' AS model, label, max_z AS score FROM scored WHERE split = 'validation'
  UNION ALL SELECT 'zscore_value', label, {q('value__z')} FROM scored WHERE split = 'validation'
  UNION ALL SELECT 'zscore_rolling', label, greatest({', '.join(q(f + '__z') for f in rolling)}) FROM scored WHERE split = 'validation'),
v AS (SELECT model, label, score, CAST(score > 3.0 AS INTEGER) AS prediction FROM zl),
c AS (SELECT model, {_CONF} FROM v GROUP BY model),
prf AS (SELECT model, {_prf_sql()} FROM c)
{_CUM.format(by='model, ', pby='model', src='v')},
auc AS (SELECT model, sum(neg * (pos_above + pos / 2.0)) / nullif(any_value(P) * any_value(N), 0) AS auc FROM cum GROUP BY model),
mm AS (SELECT prf.model, f1, recall, precision, auc FROM prf LEFT JOIN auc ON prf.model = auc.model)"""


@register("model_comparison", _models_sql() + """
SELECT model, round(f1, 8) AS f1, round(recall, 8) AS recall, round(precision, 8) AS precision, round(auc, 8) AS auc FROM mm""")
def model_comparison(spark, sf):
    m = ev.model_metrics(_model_scores(spark, sf))
    return rounded(m.select("model", "f1", "recall", "precision", "auc"), 8)


@register("metrics_sorted", _models_sql() + """
SELECT model, round(f1, 8) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank FROM mm""")
def metrics_sorted(spark, sf):
    m = ev.model_metrics(_model_scores(spark, sf)).select("model", "f1")
    return rounded(ev.rank_by(m, "f1", "model"), 8)


@register("top_importance", _SQL + """
, inv AS (""" + "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, 1.0 / abs({q(f + '__zs')}) AS v FROM fit" for f in E_FEATS) + """),
imp AS (SELECT feature, v / sum(v) OVER () AS importance FROM inv)
SELECT 'zscore' AS model, feature, round(importance, 8) AS importance, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp) WHERE rank <= 5""")
def top_importance(spark, sf):
    s = events_scored(spark, sf)
    imp = dt.zscore_importance(s.zmodel)
    df = spark.createDataFrame([("zscore", f, float(v)) for f, v in imp.items()], "model string, feature string, importance double")
    return rounded(ev.rank_by(df, "importance", "feature", ["model"], n=5), 8)
