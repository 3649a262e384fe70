"""Bound queries: slices, casts, heads and name rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.functions.scalar import base_of, clock_text, has_suffix
from procsig.operators import prepare as pr
from procsig.operators import stats as st
from procsig.operators.features import feature_names
from procsig.plans.registry import register, rounded
from procsig.sources.tables import EVENTS, LINEITEM, table

LV = list(LINEITEM.variables)


@register("series_slice", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 3""")
def series_slice(spark, sf):
    """Equality on two columns, a cap on a third (pushed into the scan)."""
    li = table(spark, sf, "lineitem")
    return pr.slice_series(li, {"l_returnflag": "R", "l_linestatus": "F"}, {"l_linenumber": 3}).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@register("cast_columns", """
SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS l_quantity, CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem""")
def cast_columns(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return pr.cast_columns(li, {"l_quantity": "int", "l_suppkey": "string"})


@register("head_rows", """
SELECT user_id, event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 10""")
def head_rows(spark, sf):
    """T4: the first n rows after an explicit order (a top-n, no global sort)."""
    return pr.head_after(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), list(EVENTS.order), 10)


@register("missing_columns", "SELECT unnest(['l_colour', 'l_weight']) AS column_name FROM (SELECT count(*) FROM lineitem)")
def missing_columns(spark, sf):
    """Required names without a column."""
    li = table(spark, sf, "lineitem")
    required = ["l_weight", *LV, "l_colour"]
    assert pr.missing_columns(li, required) == ["l_weight", "l_colour"]
    return pr.missing_columns_df(spark, li, required)


@register("base_names", "SELECT f AS feature, regexp_extract(f, '^([^_]*_[^_]*)', 1) AS base, (SELECT count(*) FROM lineitem) AS n_rows FROM (SELECT unnest(["
          + ", ".join(f"'{f}'" for f in feature_names(LV)) + "]) AS f)")
def base_names(spark, sf):
    """the base variable of every feature column, from its name."""
    li = table(spark, sf, "lineitem").agg(F.count("*").alias("n_rows"))
    return li.select(F.explode(F.array(*[F.lit(f) for f in feature_names(LV)])).alias("feature"), "n_rows").select("feature", base_of("feature").alias("base"), "n_rows")


@register("clock_and_suffix", """
SELECT strftime(ts, '%H:%M') AS clock, count(*) AS n, count(*) FILTER (WHERE lower(event_type || CASE WHEN event_id % 2 = 0 THEN '.CSV' ELSE '.txt' END) LIKE '%.csv') AS n_csv
FROM events GROUP BY 1""")
def clock_and_suffix(spark, sf):
    """events per time of day, and how many of their (made-up) file names end in .csv in any case."""
    name = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, ".CSV").otherwise(".txt"))
    return table(spark, sf, "events").groupBy(clock_text("ts").alias("clock")).agg(F.count("*").alias("n"), F.count_if(has_suffix(name)).alias("n_csv"))


@register("absolute_correlation", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(abs(corr({a}, {b})), 6) AS corr FROM lineitem" for i, a in enumerate(LV) for b in LV[i + 1:]))
def absolute_correlation(spark, sf):
    """correlation without its sign."""
    m = st.correlation_matrix(table(spark, sf, "lineitem").select(*LV), LV, absolute=True)
    x, y, c = m.columns[:3]
    order = {v: i for i, v in enumerate(LV)}
    at = F.create_map(*[z for k, v in order.items() for z in (F.lit(k), F.lit(v))])
    return rounded(m.where(F.element_at(at, F.col(x)) < F.element_at(at, F.col(y))).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(c).alias("corr")), 6)
