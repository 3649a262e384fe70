"""Bound queries: dataset profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.operators import features as fe
from procsig.operators import profile as pf
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import feature_sql, q, win
from procsig.sources.tables import EVENTS, LINEITEM, TABLES, table

LV = list(LINEITEM.variables)
LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _describe_sql(cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
            f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, "
            f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM lineitem")
    return "\nUNION ALL\n".join(parts)


NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LV]


@register("describe", _describe_sql(NUMERIC))
def describe(spark, sf):
    return rounded(pf.describe(table(spark, sf, "lineitem")), 6)


_E_FEATS = fe.feature_names(["value"])
_MISS_COLS = ["user_id", "ts", "event_id"] + _E_FEATS


def _missing_sql():
    base = (f"SELECT user_id, ts, event_id, value, {', '.join(feature_sql(['value'], win(EVENTS)))} "
            f"FROM events WHERE user_id IS NOT NULL")
    dbl = set(_E_FEATS)
    parts = []
    for c in _MISS_COLS:
        cond = f"{q(c)} IS NULL" + (f" OR isnan({q(c)})" if c in dbl else "")
        parts.append(f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS m_{len(parts)}")
    sel = ", ".join(parts)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, m_{i} AS n_missing FROM m" for i, c in enumerate(_MISS_COLS))
    total = " + ".join(f"m_{i}" for i in range(len(_MISS_COLS)))
    return f"WITH f AS ({base}), m AS (SELECT {sel} FROM f)\n{rows}\nUNION ALL SELECT '__total__', CAST({total} AS BIGINT) FROM m"


@register("missing_counts", _missing_sql())
def missing_counts(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    feats = fe.lag_features(ev, EVENTS.spec, (1, 2), ["value"], dropna=False, chunks="auto")
    feats = fe.rolling_features(feats, EVENTS.spec, (3,), ["value"], dropna=False, chunks="auto")
    feats = fe.diff_features(feats, EVENTS.spec, ["value"], dropna=False, chunks="auto")
    return pf.missing_counts(feats.select(*_MISS_COLS))


def _events_twice(spark, sf):
    """Whole event rows, those of errors twice."""
    ev = table(spark, sf, "events")
    return ev.unionByName(ev.filter(EVENTS.label))


@register("duplicate_pct", """
WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error'),
g AS (SELECT *, count(*) AS c FROM e GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates,
       round(CAST(sum(c) - count(*) AS DOUBLE) * 100.0 / CAST(sum(c) AS DOUBLE), 3) AS duplicate_pct
FROM g
""")
def duplicate_pct(spark, sf):
    return pf.duplicate_stats(_events_twice(spark, sf))


@register("drop_duplicates", "SELECT DISTINCT * FROM events")
def drop_duplicates(spark, sf):
    return pf.drop_duplicates(_events_twice(spark, sf))


@register("distinct_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM lineitem" for c in LI_COLS))
def distinct_counts(spark, sf):
    return pf.distinct_counts(table(spark, sf, "lineitem").select(*LI_COLS))


@register("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf):
    return pf.distinct_values(table(spark, sf, "events"), "event_type")


_TYPE_MAP = ("CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
             "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(t) END")


@register("shape_summary", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {_TYPE_MAP.replace(' t ', f' any_value(typeof({c})) ').replace('(t)', f'(any_value(typeof({c})))')} "
    f"AS data_type, count({c}) AS non_null, count(*) AS n_rows, {len(LI_COLS)} AS n_cols FROM lineitem" for c in LI_COLS))
def shape_summary(spark, sf):
    return pf.shape_summary(table(spark, sf, "lineitem").select(*LI_COLS))


@register("sample_range", """
SELECT user_id, min(event_id) AS min, max(event_id) AS max FROM events GROUP BY user_id
""")
def sample_range(spark, sf):
    return pf.value_range(table(spark, sf, "events"), "event_id", ["user_id"])


@register("table_sizes", "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_sizes(spark, sf):
    return pf.table_sizes({t: table(spark, sf, t) for t in TABLES})
