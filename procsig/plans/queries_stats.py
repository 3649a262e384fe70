"""Bound queries: exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.operators import features as fe
from procsig.operators import stats as st
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import win
from procsig.sources.tables import EVENTS, LINEITEM, table

LV = list(LINEITEM.variables)


def _li(spark, sf):
    return table(spark, sf, "lineitem")


# ---------------------------------------------------------------- A10 correlation
def _corr_sql(group: str | None):
    parts = []
    for i, a in enumerate(LV):
        for b in LV[i:]:
            f = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND NOT isnan({a}) AND NOT isnan({b}))"
            r = f"covar_pop({a}, {b}) {f} / nullif(stddev_pop({a}) {f} * stddev_pop({b}) {f}, 0)"
            g = f"{group}, " if group else ""
            gb = f" GROUP BY {group}" if group else ""
            parts.append(f"SELECT {g}'{a}' AS var_a, '{b}' AS var_b, round({r}, 6) AS corr FROM lineitem{gb}")
    return "\nUNION ALL\n".join(parts)


@register("correlation_matrix", _corr_sql(None))
def correlation_matrix(spark, sf):
    return rounded(st.correlation_matrix(_li(spark, sf), LV), 6)


@register("correlation_by_category", _corr_sql("l_linestatus"))
def correlation_by_category(spark, sf):
    return rounded(st.correlation_matrix(_li(spark, sf), LV, by=["l_linestatus"]), 6)


# ---------------------------------------------------------------- A11-A13 variability
_VAR_LONG = "\nUNION ALL\n".join(f"SELECT '{c}' AS variable, l_returnflag AS category, {c}::DOUBLE AS value FROM lineitem"
                                 for c in LV)
_VAR_CTE = f"""WITH long AS ({_VAR_LONG}),
v AS (SELECT variable, category, stddev_samp(value) AS std, avg(value) AS mean, max(value) - min(value) AS range
      FROM long GROUP BY variable, category),
cv AS (SELECT *, CASE WHEN mean = 0 THEN 0.0::DOUBLE ELSE std / nullif(mean, 0) END AS cv FROM v)"""


@register("variability_cv", f"""{_VAR_CTE}
SELECT variable, category, round(std, 6) AS std, round(mean, 6) AS mean, round(range, 6) AS range, round(cv, 6) AS cv
FROM cv""")
def variability_cv(spark, sf):
    return rounded(st.variability(_li(spark, sf), LV, "l_returnflag"), 6)


@register("variability_pivot", f"""{_VAR_CTE}
SELECT variable, {', '.join(f"max(CASE WHEN category = '{c}' THEN round(cv, 6) END) AS {c}" for c in "ANR")} FROM cv GROUP BY variable""")
def variability_pivot(spark, sf):
    """One column per category found in the data (the SQL names those of the given tables)."""
    v = st.variability(_li(spark, sf), LV, "l_returnflag")
    return rounded(st.pivot_wide(v, "variable", "category", "cv"), 6)


@register("variability_normalised", f"""{_VAR_CTE}
SELECT variable, category, round(cv, 6) AS cv,
       round(cv / nullif(max(cv) OVER (PARTITION BY category), 0), 6) AS cv_norm
FROM cv""")
def variability_normalised(spark, sf):
    v = st.variability(_li(spark, sf), LV, "l_returnflag")
    return rounded(st.normalise_by_max(v, "cv", "category", "cv_norm").select("variable", "category", "cv", "cv_norm"), 6)


# ---------------------------------------------------------------- A14 box statistics
@register("box_stats", f"""WITH long AS ({_VAR_LONG}),
k AS (SELECT * FROM long WHERE value IS NOT NULL),
qs AS (SELECT variable, category, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM k GROUP BY variable, category),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM qs)
SELECT f.variable, f.category, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
       round(min(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END), 6) AS whisker_low,
       round(max(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END), 6) AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT (value >= lower_fence AND value <= upper_fence)) AS BIGINT) AS n_outliers,
       count(*) AS n
FROM k JOIN f ON k.variable = f.variable AND k.category = f.category
GROUP BY f.variable, f.category, q1, median, q3, iqr, lower_fence, upper_fence""")
def box_stats(spark, sf):
    return rounded(st.box_stats(_li(spark, sf), LV, "l_returnflag"), 6)


# ---------------------------------------------------------------- A15 histograms
def _hist_sql(col: str, bins: int, hue: str | None):
    g = f"{hue} AS category, " if hue else ""
    gb = "category, " if hue else ""
    cats = "(SELECT DISTINCT category FROM k)" if hue else "(SELECT 1 AS one)"
    return f"""WITH r AS (SELECT min({col}::DOUBLE) AS lo, max({col}::DOUBLE) AS hi FROM lineitem WHERE NOT isnan({col})),
k AS (SELECT {g}{col}::DOUBLE AS x FROM lineitem WHERE {col} IS NOT NULL AND NOT isnan({col})),
c AS (SELECT {gb}least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) AS bin, count(*) AS n
      FROM k, r GROUP BY ALL),
s AS (SELECT {gb}CAST(b AS INTEGER) AS bin FROM {cats}, range({bins}) t(b)),
h AS (SELECT {gb}bin, coalesce(n, 0) AS count FROM s LEFT JOIN c USING ({gb}bin))
SELECT {gb}bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_left, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS bin_right,
       count, round(count / sum(count) OVER (), 8) AS probability
FROM h, r"""


@register("histogram", _hist_sql("l_extendedprice", 25, None))
def histogram(spark, sf):
    return rounded(st.histogram(_li(spark, sf), "l_extendedprice", 25), {"probability": 8, "*": 6})


@register("histogram_by_category", _hist_sql("l_extendedprice", 25, "l_returnflag"))
def histogram_by_category(spark, sf):
    return rounded(st.histogram(_li(spark, sf), "l_extendedprice", 25, hue="l_returnflag"), {"probability": 8, "*": 6})


# ---------------------------------------------------------------- A16-A18 distributions
@register("normal_fit", """
WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sigma, min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 499 AS x, mu, sigma FROM s, generate_series(0, 499) t(i))
SELECT i, round(x, 6) AS x, round(mu, 6) AS mu, round(sigma, 6) AS sigma,
       round(exp(-pow((x - mu) / sigma, 2) / 2) / (sigma * sqrt(2 * pi())), 8) AS pdf
FROM g""")
def normal_fit(spark, sf):
    return rounded(st.normal_fit(table(spark, sf, "events"), "value", 500), {"pdf": 8, "*": 6})


@register("kde_curve", """
WITH k AS (SELECT value AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, stddev_samp(x) AS sd FROM k),
cells AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * 512) AS INTEGER), 511) AS b, count(*)::DOUBLE AS w
          FROM k, s GROUP BY 1),
c AS (SELECT lo + (b + 0.5) * ((hi - lo) / 512) AS c, w FROM cells, s),
g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * ((hi - lo) / 199) AS x, n, sd * pow(n, -0.2) AS h
      FROM s, generate_series(0, 199) t(i))
SELECT i, round(x, 6) AS x, round(sum(w * exp(-pow((x - c) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 8) AS density
FROM g, c GROUP BY i, x, n, h""")
def kde_curve(spark, sf):
    return rounded(st.kde_curve(table(spark, sf, "events"), "value", 200, 512), {"density": 8, "*": 6})


@register("transform_distributions", """
SELECT 'raw' AS transform, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
FROM (SELECT l_extendedprice AS x FROM lineitem)
UNION ALL
SELECT 'sqrt', count(x), round(avg(x), 6), round(stddev_pop(x), 6)
FROM (SELECT CASE WHEN l_extendedprice >= 0 THEN sqrt(l_extendedprice) END AS x FROM lineitem)
UNION ALL
SELECT 'log', count(x), round(avg(x), 6), round(stddev_pop(x), 6)
FROM (SELECT CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END AS x FROM lineitem)""")
def transform_distributions(spark, sf):
    return rounded(st.transform_moments(_li(spark, sf), "l_extendedprice"), 6)


# ---------------------------------------------------------------- A19-A20 mutual information
def _mi_sql(bins: int = 10):
    rng = ", ".join(f"min({c}::DOUBLE) AS lo_{i}, max({c}::DOUBLE) AS hi_{i}" for i, c in enumerate(LV))
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, least(CAST(floor(({c} - lo_{i}) / (hi_{i} - lo_{i}) * {bins}) AS INTEGER), {bins - 1}) AS bin, "
        f"l_returnflag = 'R' AS y FROM lineitem, r WHERE {c} IS NOT NULL AND NOT isnan({c}) AND l_returnflag IS NOT NULL"
        for i, c in enumerate(LV))
    return f"""WITH r AS (SELECT {rng} FROM lineitem),
long AS ({long}),
cells AS (SELECT feature, bin, y, count(*)::DOUBLE AS n_xy FROM long GROUP BY ALL),
m AS (SELECT *, sum(n_xy) OVER (PARTITION BY feature) AS n, sum(n_xy) OVER (PARTITION BY feature, bin) AS n_x,
             sum(n_xy) OVER (PARTITION BY feature, y) AS n_y FROM cells),
mi AS (SELECT feature, sum(n_xy / n * ln(n_xy * n / (n_x * n_y))) AS mi FROM m GROUP BY feature)"""


def _mi(spark, sf):
    li = _li(spark, sf).select(*LV, LINEITEM.label.alias("label"))
    return st.mutual_information(li, LV, "label", 10)


@register("mutual_info", _mi_sql() + "\nSELECT feature, round(mi, 12) AS mi FROM mi")
def mutual_info(spark, sf):
    return rounded(_mi(spark, sf), 12)


@register("top_k_features", _mi_sql() + """
SELECT feature, round(mi, 12) AS mi, rank FROM (
  SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank FROM mi)
WHERE rank <= 2""")
def top_k_features(spark, sf):
    return rounded(st.top_k(_mi(spark, sf), "mi", 2), 12)


# ---------------------------------------------------------------- W11 anomaly period
@register("anomaly_period", f"""
WITH s AS (SELECT user_id, event_type, CAST(row_number() OVER ({win(EVENTS)}) AS INTEGER) AS sample
           FROM events WHERE user_id IS NOT NULL)
SELECT user_id, min(CASE WHEN event_type = 'error' THEN sample END) AS period_start, max(sample) AS period_end
FROM s GROUP BY user_id HAVING min(CASE WHEN event_type = 'error' THEN sample END) IS NOT NULL""")
def anomaly_period(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", EVENTS.label.alias("label"))
    s = fe.with_sample_number(EVENTS.spec.drop_null_keys(ev), EVENTS.spec, chunks="auto")
    return st.anomaly_period(s, ["user_id"], "sample", "label")


# ---------------------------------------------------------------- W12 series comparison
@register("timeseries_compare", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, l_returnflag AS category, l_suppkey, l_linenumber, round(avg({c}::DOUBLE), 6) AS value, "
    f"l_linenumber > 3 AS after_marker FROM lineitem GROUP BY l_returnflag, l_suppkey, l_linenumber" for c in LV))
def timeseries_compare(spark, sf):
    out = st.series_compare(_li(spark, sf), LV, "l_returnflag", "l_suppkey", "l_linenumber", 3)
    return rounded(out, 6)
