"""Bound queries: windowed features (W1-W7) and preparation (P*, U*, J1/J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.operators import features as fe
from procsig.operators import prepare as pr
from procsig.plans.guard import bounded_broadcast
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import complete, feature_sql, lag_sql, q, rnd, rolling_sql, win
from procsig.sources.tables import EVENTS, LINEITEM, table

E, L = EVENTS, LINEITEM
EW, LW = win(E), win(L)
LV = list(L.variables)
E_FEATS = fe.feature_names(["value"])
L_FEATS = fe.feature_names(LV)


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "value")


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", *LV)


# ---------------------------------------------------------------- W1 lag
@register("lag_features", f"""
SELECT user_id, event_id, value, value_lag_1, value_lag_2 FROM (
  SELECT user_id, ts, event_id, value, {lag_sql('value', 1, EW)}, {lag_sql('value', 2, EW)}
  FROM events WHERE user_id IS NOT NULL)
WHERE {complete(['user_id', 'ts', 'event_id', 'value', 'value_lag_1', 'value_lag_2'],
                ['value', 'value_lag_1', 'value_lag_2'])}
""")
def lag_features(spark, sf):
    out = fe.lag_features(_events(spark, sf), E.spec, (1, 2), ["value"], dropna=True, chunks="auto")
    return out.select("user_id", "event_id", "value", "value_lag_1", "value_lag_2")


@register("lead_features", f"""
SELECT user_id, event_id, value, {q('value_lag_-1')}, {q('value_lag_-2')}
FROM (SELECT user_id, event_id, value, {lag_sql('value', -1, EW)}, {lag_sql('value', -2, EW)}
      FROM events WHERE user_id IS NOT NULL)
""")
def lead_features(spark, sf):
    out = fe.lag_features(_events(spark, sf), E.spec, (-1, -2), ["value"], dropna=False, chunks="auto")
    return out.select("user_id", "event_id", "value", "value_lag_-1", "value_lag_-2")


@register("mixed_lags_chunked", f"""
SELECT user_id, event_id, value, {q('value_lag_2')}, {q('value_lag_-3')}
FROM (SELECT user_id, event_id, value, {lag_sql('value', 2, EW)}, {lag_sql('value', -3, EW)}
      FROM events WHERE user_id IS NOT NULL)
""")
def mixed_lags_chunked(spark, sf):
    """Hot-series form of W1 in both directions: four ranges per series, halos before and behind."""
    out = fe.lag_features(_events(spark, sf), E.spec, (2, -3), ["value"], dropna=False, chunks=4)
    return out.select("user_id", "event_id", "value", "value_lag_2", "value_lag_-3")


# ---------------------------------------------------------------- W2 rolling
_ROLL = [fe.rolling_name(c, s, 3) for c in LV for s in fe.ROLLING_STATS]


@register("rolling_features", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, {rnd(_ROLL, 6)} FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber,
         {', '.join(rolling_sql(c, 3, s, LW) for c in LV for s in fe.ROLLING_STATS)}
  FROM lineitem WHERE l_suppkey IS NOT NULL)
""")
def rolling_features(spark, sf):
    out = fe.rolling_features(_lineitem(spark, sf), L.spec, (3,), LV, dropna=False, chunks="auto")
    return rounded(out.select("l_suppkey", "l_orderkey", "l_linenumber", *_ROLL), 6)


# ---------------------------------------------------------------- W3 diff
_DIFF = [fe.diff_name(c) for c in LV]


@register("diff_features", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, {rnd(_DIFF, 6)} FROM (
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, {', '.join(LV)},
         {', '.join(f"{c} - lag({c}, 1) OVER ({LW}) AS {c}_diff" for c in LV)}
  FROM lineitem WHERE l_suppkey IS NOT NULL)
WHERE {complete(['l_suppkey', 'l_shipdate', 'l_orderkey', 'l_linenumber'] + LV + _DIFF, LV + _DIFF)}
""")
def diff_features(spark, sf):
    out = fe.diff_features(_lineitem(spark, sf), L.spec, LV, dropna=True, chunks="auto")
    return rounded(out.select("l_suppkey", "l_orderkey", "l_linenumber", *_DIFF), 6)


# ---------------------------------------------------------------- W4 training chain
_EBASE = ["user_id", "ts", "event_id", "value"]
_ELAG = ["value_lag_1", "value_lag_2"]
_EROLL = [fe.rolling_name("value", s, 3) for s in fe.ROLLING_STATS]


@register("feature_chain_train", f"""
WITH s1 AS (
  SELECT * FROM (SELECT {', '.join(_EBASE)}, {lag_sql('value', 1, EW)}, {lag_sql('value', 2, EW)}
                 FROM events WHERE user_id IS NOT NULL)
  WHERE {complete(_EBASE + _ELAG, ['value'] + _ELAG)}),
s2 AS (
  SELECT * FROM (SELECT *, {', '.join(rolling_sql('value', 3, s, EW) for s in fe.ROLLING_STATS)} FROM s1)
  WHERE {complete(_EBASE + _ELAG + _EROLL, ['value'] + _ELAG + _EROLL)}),
s3 AS (
  SELECT * FROM (SELECT *, value - lag(value, 1) OVER ({EW}) AS value_diff FROM s2)
  WHERE {complete(_EBASE + _ELAG + _EROLL + ['value_diff'], ['value'] + _ELAG + _EROLL + ['value_diff'])})
SELECT user_id, event_id, {rnd(E_FEATS, 6)} FROM s3
""")
def feature_chain_train(spark, sf):
    out = fe.feature_chain_train(_events(spark, sf), E.spec, ["value"], chunks="auto")
    return rounded(out.select("user_id", "event_id", *E_FEATS), 6)


# ---------------------------------------------------------------- W5 serving chain
@register("feature_chain_serving", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, {rnd(L_FEATS, 6)} FROM (
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, {', '.join(LV)}, {', '.join(feature_sql(LV, LW))}
  FROM lineitem WHERE l_suppkey IS NOT NULL)
WHERE {complete(['l_suppkey', 'l_shipdate', 'l_orderkey', 'l_linenumber'] + L_FEATS, L_FEATS)}
""")
def feature_chain_serving(spark, sf):
    out = fe.feature_chain_serving(_lineitem(spark, sf), L.spec, LV, chunks="auto")
    return rounded(out.select("l_suppkey", "l_orderkey", "l_linenumber", *L_FEATS), 6)


# ---------------------------------------------------------------- W7 global window, chunked
_GW = "ORDER BY ts, event_id"


@register("global_window_halo", f"""
SELECT event_id, {rnd(['value_lag_1', 'value_lag_2'] + _EROLL, 6)} FROM (
  SELECT event_id, {lag_sql('value', 1, _GW)}, {lag_sql('value', 2, _GW)},
         {', '.join(rolling_sql('value', 3, s, _GW) for s in fe.ROLLING_STATS)}
  FROM events)
""")
def global_window_halo(spark, sf):
    spec = fe.SeriesSpec((), ("ts", "event_id"))

    def build(s):
        return fe.lag_exprs(s, ["value"], (1, 2)) + fe.rolling_exprs(s, ["value"], (3,))

    out = fe.chunked_window(_events(spark, sf), spec, halo=2, build=build, n_chunks=8)
    return rounded(out.select("event_id", "value_lag_1", "value_lag_2", *_EROLL), 6)


# ---------------------------------------------------------------- P4 onset label, sample number
@register("onset_label", f"""
SELECT user_id, event_id, sample, (event_type = 'error' AND sample > 20) AS faulty FROM (
  SELECT user_id, event_id, event_type, CAST(row_number() OVER ({EW}) AS INTEGER) AS sample
  FROM events WHERE user_id IS NOT NULL)
""")
def onset_label(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    s = fe.with_sample_number(E.spec.drop_null_keys(ev), E.spec, chunks="auto")
    fault = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return pr.onset_label(s, fault, "sample", 20).select("user_id", "event_id", "sample", "faulty")


# ---------------------------------------------------------------- P2 prefix projection
_VPREF = ["value"] + _ELAG + _EROLL + ["value_diff"]


@register("prefix_projection", f"""
SELECT user_id, event_id, {rnd(_VPREF, 6)} FROM (
  SELECT user_id, ts, event_id, value, {', '.join(feature_sql(['value'], EW))}
  FROM events WHERE user_id IS NOT NULL)
WHERE {complete(['user_id', 'ts', 'event_id'] + _VPREF, _VPREF)}
""")
def prefix_projection(spark, sf):
    feats = fe.feature_chain_serving(_events(spark, sf), E.spec, ["value"], chunks="auto")
    return rounded(pr.select_prefixed(feats, ["value"], keep=["user_id", "event_id"]), 6)


# ---------------------------------------------------------------- P11 holdout split
@register("run_holdout_split", """
SELECT DISTINCT user_id,
  CASE WHEN user_id <= (SELECT min(user_id) + 0.8 * (max(user_id) - min(user_id)) FROM events)
       THEN 'train' ELSE 'validation' END AS split
FROM events
""")
def run_holdout_split(spark, sf):
    ev = table(spark, sf, "events").select("user_id")
    return pr.holdout_split(ev, "user_id", 0.8).distinct()


# ---------------------------------------------------------------- P5 / S5 membership + range filter
@register("filter_runs", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
WHERE l_returnflag IN ('R', 'N') AND l_quantity <= 25
""")
def filter_runs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return pr.filter_members(li, "l_returnflag", ["R", "N"], "l_quantity", 25)


# ---------------------------------------------------------------- P8 normal subset
@register("normal_subset", """
SELECT event_id, user_id, value FROM events WHERE NOT (event_type = 'error')
""")
def normal_subset(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value", E.label.alias("label"))
    return pr.normal_subset(ev, "label").select("event_id", "user_id", "value")


# ---------------------------------------------------------------- P10 analysis sequence (batch)
@register("analysis_sequence", f"""
WITH s AS (SELECT user_id, ts, event_id, event_type,
                  CAST(row_number() OVER ({EW}) AS INTEGER) AS sample FROM events WHERE user_id IS NOT NULL)
SELECT user_id, sample,
       coalesce(sample >= 3 AND lag(sample, 1) OVER ({EW}) = sample - 1
                AND lag(sample, 2) OVER ({EW}) = sample - 2, false) AS seq_ok
FROM s
""")
def analysis_sequence(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    s = fe.with_sample_number(E.spec.drop_null_keys(ev), E.spec, chunks="auto")
    return pr.analysis_sequence_check(s, E.spec, "sample", 3, chunks="auto").select("user_id", "sample", "seq_ok")


# ---------------------------------------------------------------- P9 positional slice
@register("positional_slice", f"""
SELECT user_id, event_id, pos FROM (
  SELECT user_id, event_id, CAST(row_number() OVER ({EW}) - 1 AS INTEGER) AS pos
  FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)
WHERE pos >= 10 AND pos < 13
""")
def positional_slice(spark, sf):
    ev = table(spark, sf, "events").filter(E.label).select("user_id", "ts", "event_id")
    out = pr.positional_slice(E.spec.drop_null_keys(ev), E.spec, 10, 13, chunks="auto")
    return out.select("user_id", "event_id", "pos")


# ---------------------------------------------------------------- U1 union by name
@register("union_splits", """
SELECT event_id, user_id, value, NULL::VARCHAR AS event_type FROM events WHERE event_type = 'error'
UNION ALL
SELECT event_id, user_id, value, event_type FROM events WHERE NOT (event_type = 'error')
""")
def union_splits(spark, sf):
    ev = table(spark, sf, "events")
    faulty = ev.filter(E.label).select("event_id", "user_id", "value")
    normal = ev.filter(~E.label).select("event_id", "user_id", "value", "event_type")
    return pr.union_all([faulty, normal])


# ---------------------------------------------------------------- P12 drop missing
@register("drop_missing", f"""
SELECT user_id, event_id, value, {q('value_lag_-3')} FROM (
  SELECT user_id, ts, event_id, value, {lag_sql('value', -3, EW)} FROM events WHERE user_id IS NOT NULL)
WHERE {complete(['user_id', 'ts', 'event_id', 'value', 'value_lag_-3'], ['value', 'value_lag_-3'])}
""")
def drop_missing(spark, sf):
    out = fe.lag_features(_events(spark, sf), E.spec, (-3,), ["value"], dropna=False, chunks="auto")
    return pr.drop_missing(out).select("user_id", "event_id", "value", "value_lag_-3")


# ---------------------------------------------------------------- J1/J2 dimension lookup
@register("dimension_lookup", """
SELECT c.c_custkey, n.n_name, r.r_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def dimension_lookup(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = bounded_broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), 10_000)
    region = bounded_broadcast(table(spark, sf, "region").select("r_regionkey", "r_name"), 10_000)
    out = (cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
           .join(region, nation.n_regionkey == region.r_regionkey, "left"))
    return out.select("c_custkey", "n_name", "r_name")


@register("unknown_key_check", """
SELECT DISTINCT o_orderkey AS unknown_key FROM orders
WHERE o_orderkey IS NOT NULL AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)
""")
def unknown_key_check(spark, sf):
    """Keys of one table that another does not name: anti-join over both whole tables."""
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unknown_key"))
    known = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unknown_key"))
    return keys.filter(F.col("unknown_key").isNotNull()).join(known, "unknown_key", "left_anti").distinct()
