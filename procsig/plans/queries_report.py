"""Bound queries: attribution, alert report and analysis record."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.functions.scalar import ZERO_STD_GUARD, cache_key_sql, percent_text_sql
from procsig.functions.text import feature_description_expr, feature_description_sql
from procsig.operators import explain as ex
from procsig.operators import report as rp
from procsig.operators.features import feature_catalog, feature_names
from procsig.plans.analysis import flatten_top
from procsig.plans.bound import (E_FEATS, THRESHOLD, TRAIN_FRACTION, events_scored, events_scored_sql, lineitem_records,
                                 lineitem_records_sql)
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import feature_sql, q, win
from procsig.session import cut_lineage
from procsig.sources.tables import LINEITEM, VARIABLE_DESCRIPTIONS, variable_dim

LV = list(LINEITEM.variables)
L_FEATS = feature_names(LV)
_ESQL = events_scored_sql()
_LSQL = lineitem_records_sql()


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_PCT = percent_text_sql("confidence")
_CONTEXT = (f"CASE WHEN tier = 'NORMAL' THEN 'NORMAL: ' || {_PCT} || ' anomaly probability' "
            f"ELSE tier || ': ' || {_PCT} || ' confidence - key factors: ' || concat_ws(', ', d1, d2, d3) END")
_TEMPLATE = "CASE tier " + " ".join(f"WHEN '{k}' THEN {_sql_str(v)}" for k, v in rp.DEFAULT_TEMPLATES.items()) + " END"
_KEY = cache_key_sql("confidence", "CASE WHEN confidence >= 0.5 THEN [d1, d2, d3] ELSE []::VARCHAR[] END")
_ERR = _sql_str("STATUS: ERROR - fewer than three consecutive samples end at this sample")

_TEXTS = _LSQL + f""",
recs AS (SELECT rec.*, CASE WHEN status = 'OK' THEN {_CONTEXT} END AS context,
                CASE WHEN status = 'OK' THEN {_TEMPLATE} END AS template,
                CASE WHEN status = 'OK' THEN {_KEY} END AS cache_key FROM rec)"""

_RESP = f""",
responses AS (SELECT DISTINCT cache_key, CASE WHEN tier = 'ALERT' THEN template || chr(10) || 'SOURCE: external'
                                          ELSE template END AS response FROM recs WHERE status = 'OK'),
checked AS (SELECT cache_key, response, contains(response, 'STATUS:') AND contains(response, 'ISSUE:')
                   AND contains(response, 'ROOT CAUSE:') AND contains(response, 'IMMEDIATE ACTION:')
                   AND contains(response, 'MONITORING:') AS is_valid FROM responses),
cache AS (SELECT cache_key, arg_min(trim(response), response) AS response FROM checked WHERE is_valid GROUP BY cache_key),
resolved AS (SELECT recs.*, coalesce(cache.response, template) AS explanation, cache.response IS NOT NULL AS from_cache
             FROM recs LEFT JOIN cache ON recs.cache_key = cache.cache_key WHERE status = 'OK')"""

_ACTION = ("coalesce(nullif(trim(regexp_extract(explanation, '(?m)^IMMEDIATE ACTION:(.*)$', 1)), ''), "
           "'Monitor process parameters')")


def _records(spark, sf):
    return lineitem_records(spark, sf)


def _ok(spark, sf, keep: tuple = ()):
    return lineitem_records(spark, sf, keep=keep).filter(F.col("status") == "OK")


def _ok_shared(spark, sf, keep: tuple = ()):
    """OK records materialised once (reliable checkpoint in the shared checkpoint folder):
    they feed both sides of the response join, so they are computed a single time and the
    join plans over a short lineage."""
    return cut_lineage(_with_template(_ok(spark, sf, keep)))


def _responses(recs):
    """External answers as a table: derived here from the records (ALERT ones marked external)."""
    resp = F.when(F.col("tier") == "ALERT", F.concat(F.col("template_text"), F.lit("\nSOURCE: external"))) \
        .otherwise(F.col("template_text"))
    return recs.select("cache_key", resp.alias("response")).distinct()


def _with_template(recs):
    return recs.select("*", rp.template_text(F.col("tier")).alias("template_text"))


# ---------------------------------------------------------------- R11 analysis record (flagship)
@register("analysis_record", _TEXTS + f"""
SELECT l_suppkey, sample, label, split, status, round(max_z, 6) AS max_z, prediction, round(confidence, 6) AS confidence,
       tier, top1_variable, round(top1_score, 4) AS top1_score, top2_variable,
       round(top2_score, 4) AS top2_score, top3_variable, round(top3_score, 4) AS top3_score,
       context, CASE WHEN status = 'OK' THEN template ELSE {_ERR} END AS explanation, cache_key
FROM recs""")
def analysis_record(spark, sf):
    rec = flatten_top(_records(spark, sf))
    return rounded(rec, {"max_z": 6, "confidence": 6, "*": 4})


def _record_sql():
    return _TEXTS + f"""
SELECT l_suppkey, sample, label, split, status, round(max_z, 6) AS max_z, prediction, round(confidence, 6) AS confidence,
       tier, top1_variable, round(top1_score, 4) AS top1_score, top2_variable,
       round(top2_score, 4) AS top2_score, top3_variable, round(top3_score, 4) AS top3_score,
       context, CASE WHEN status = 'OK' THEN template ELSE {_ERR} END AS explanation, cache_key
FROM recs"""


@register("analysis_record_chunked", _record_sql())
def analysis_record_chunked(spark, sf):
    """Hot-series form of the analysis record: every series numbered and windowed in 8
    parallel ranges (exact offsets, halo rows); must equal the one-window form."""
    rec = flatten_top(lineitem_records(spark, sf, chunks=8))
    return rounded(rec, {"max_z": 6, "confidence": 6, "*": 4})


# ---------------------------------------------------------------- R1 contributions (events, z-score)
@register("contributions", _ESQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT user_id, event_id, '{f}' AS feature, round({q(f + '__z')} - {THRESHOLD}, 6) AS contribution FROM zrows"
    for f in E_FEATS))
def contributions(spark, sf):
    s = events_scored(spark, sf)
    return rounded(ex.zscore_contributions(s.feats, s.zmodel, THRESHOLD, ["user_id", "event_id"], s.scaler), 6)


@register("linear_contributions", _ESQL + """
, lw AS (SELECT """ + ", ".join(
    f"(avg(CASE WHEN label THEN {q(f)} END) - avg(CASE WHEN NOT label THEN {q(f)} END)) / nullif(var_pop({q(f)}), 0) "
    f"AS {q(f + '__w')}, avg({q(f)}) AS {q(f + '__mu')}" for f in E_FEATS) + """ FROM feats WHERE split = 'train')
""" + "\nUNION ALL\n".join(
    f"SELECT user_id, event_id, '{f}' AS feature, round({q(f + '__w')} * ({q(f)} - {q(f + '__mu')}), 6) AS contribution "
    f"FROM feats, lw" for f in E_FEATS))
def linear_contributions(spark, sf):
    """R1 for a linear model (diagonal discriminant fitted on the training series), for every complete row."""
    from procsig.plans.bound import events_features
    feats = events_features(spark, sf)
    w, m = ex.diagonal_discriminant(feats.filter(F.col("split") == "train"), E_FEATS)
    return rounded(ex.linear_contributions(feats, w, m, ["user_id", "event_id"]), 6)


# ---------------------------------------------------------------- A26 attribution by base (long form)
def _lineitem_contrib(spark, sf):
    from procsig.operators import features as fe
    from procsig.operators.detect import fit_scaled_zscore
    from procsig.operators.prepare import holdout_cut, holdout_split
    from procsig.plans.analysis import serving_features
    from procsig.plans.bound import TRAIN_FRACTION
    b = LINEITEM
    raw = b.spec.drop_null_keys(b.load(spark, sf))
    n = fe.series_chunks(raw.select(*b.keys), b.spec)
    samples = fe.with_sample_number(raw, b.spec, chunks=n)
    feats = serving_features(samples, b.spec, LV, chunks=n)
    feats = holdout_split(feats, "l_suppkey", TRAIN_FRACTION, cut=holdout_cut(feats, "l_suppkey", TRAIN_FRACTION))
    ok = feats.filter("ok")
    scaler, zmodel = fit_scaled_zscore(ok.filter(F.col("split") == "train"), L_FEATS, ~F.col("label"))
    return ex.zscore_contributions(ok, zmodel, THRESHOLD, ["l_suppkey", "sample"], scaler, wide=True)


def _lineitem_ok_contrib_wide(spark, sf):
    """Complete lineitem rows with one contribution column per feature (``{f}__c``)."""
    from procsig.operators import features as fe
    from procsig.operators.detect import fit_scaled_zscore, z_exprs
    from procsig.operators.prepare import holdout_cut, holdout_split
    from procsig.plans.analysis import serving_features
    from procsig.plans.bound import TRAIN_FRACTION
    b = LINEITEM
    raw = b.spec.drop_null_keys(b.load(spark, sf))
    n = fe.series_chunks(raw.select(*b.keys), b.spec)
    samples = fe.with_sample_number(raw, b.spec, chunks=n)
    feats = serving_features(samples, b.spec, LV, chunks=n)
    feats = holdout_split(feats, "l_suppkey", TRAIN_FRACTION, cut=holdout_cut(feats, "l_suppkey", TRAIN_FRACTION))
    ok = feats.filter("ok")
    scaler, zmodel = fit_scaled_zscore(ok.filter(F.col("split") == "train"), L_FEATS, ~F.col("label"))
    zc = ok.select("l_suppkey", "sample", *[z.alias(f"{f}__z") for f, z in z_exprs(zmodel, scaler).items()])
    return zc.select("l_suppkey", "sample", *[(F.col(f"{f}__z") - F.lit(THRESHOLD)).alias(f"{f}__c") for f in L_FEATS])


@register("attribution_by_base", _LSQL + "\nSELECT l_suppkey, sample, base, round(total, 6) AS total FROM tot")
def attribution_by_base(spark, sf):
    contrib = _lineitem_contrib(spark, sf)
    cat = feature_catalog(spark, LV)
    totals = ex.attribution_by_base(contrib, cat, ["l_suppkey", "sample"])
    return rounded(ex.long_totals(totals, ["l_suppkey", "sample"]), 6)


@register("top_variables", _LSQL + """
SELECT l_suppkey, sample, rank, base, description, round(total, 6) AS total FROM rk WHERE rank <= 3""")
def top_variables(spark, sf):
    """Row-wise form: per-row base totals, sorted inside the row and exploded (no shuffle)."""
    ok = _lineitem_ok_contrib_wide(spark, sf)
    groups = {v: [f for f in L_FEATS if f == v or f.startswith(v + "_")] for v in LV}
    totals = ex.base_total_exprs({f: f"{f}__c" for f in L_FEATS}, groups)
    tot = ok.select("l_suppkey", "sample", *[t.alias(f"{b}__total") for b, t in totals.items()])
    top = ex.top_bases_expr({b: f"{b}__total" for b in totals}, 3, VARIABLE_DESCRIPTIONS, digits=None)
    return rounded(ex.explode_top(tot, ["l_suppkey", "sample"], top), 6)


@register("attribution_format", _LSQL + """
SELECT l_suppkey, sample,
       top1_variable, d1 AS top1_description, round(top1_score, 4) AS top1_score,
       top2_variable, d2 AS top2_description, round(top2_score, 4) AS top2_score,
       top3_variable, d3 AS top3_description, round(top3_score, 4) AS top3_score
FROM top""")
def attribution_format(spark, sf):
    contrib = _lineitem_contrib(spark, sf)
    tot = ex.attribution_by_base(contrib, feature_catalog(spark, LV), ["l_suppkey", "sample"])
    top = ex.top_variables(tot, ["l_suppkey", "sample"], 3, variable_dim(spark))
    fmt = ex.format_attribution(top, ["l_suppkey", "sample"], 4)
    cols = []
    for i in range(3):
        item = F.col("important_features")[i]
        cols += [item["variable_name"].alias(f"top{i + 1}_variable"), item["description"].alias(f"top{i + 1}_description"),
                 item["importance_score"].alias(f"top{i + 1}_score")]
    return fmt.select("l_suppkey", "sample", *cols)


# ---------------------------------------------------------------- R4 / R5
@register("alert_context", _TEXTS + "\nSELECT l_suppkey, sample, tier, context FROM recs WHERE status = 'OK'")
def alert_context(spark, sf):
    return _ok(spark, sf).select("l_suppkey", "sample", "tier", "context")


_TIERS = f"""WITH s AS (
  SELECT l_suppkey, l_returnflag = 'R' AS label, {', '.join(LV)}, row_number() OVER w AS sample, {', '.join(x.replace(win(LINEITEM), 'w').replace('(w)', 'w') for x in feature_sql(LV, win(LINEITEM)))}
  FROM lineitem WHERE l_suppkey IS NOT NULL WINDOW w AS ({win(LINEITEM)})),
x AS (SELECT l_suppkey, sample, label, l_suppkey <= c AS train, unnest([{', '.join(q(f) for f in L_FEATS)}]) AS v, unnest(range({len(L_FEATS)})) AS j
      FROM s, (SELECT min(l_suppkey) + {TRAIN_FRACTION} * (max(l_suppkey) - min(l_suppkey)) AS c FROM lineitem)
      WHERE sample >= 3 AND {' AND '.join(f'{q(f)} IS NOT NULL AND NOT isnan({q(f)})' for f in L_FEATS)}),
m AS (SELECT j, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS s, avg(v) FILTER (NOT label) AS nm, stddev_pop(v) FILTER (NOT label) AS ns
      FROM x WHERE train GROUP BY j),
z AS (SELECT l_suppkey, sample, max(abs(((v - m) / s - (nm - m) / s) / coalesce(nullif(ns / s, 0), {ZERO_STD_GUARD}))) AS z
      FROM x JOIN m USING (j) GROUP BY l_suppkey, sample),
t AS (SELECT l_suppkey, CAST(sample AS INTEGER) AS sample, 1 / (1 + exp({THRESHOLD} - z)) AS confidence,
             CASE WHEN confidence >= 0.75 THEN 'ALERT' WHEN confidence >= 0.5 THEN 'CAUTION' ELSE 'NORMAL' END AS tier FROM z)"""


@register("alert_explanation", _TIERS + f"\nSELECT l_suppkey, sample, tier, {_TEMPLATE} AS explanation FROM t")
def alert_explanation(spark, sf):
    return _ok(spark, sf).select("l_suppkey", "sample", "tier", "explanation")


# ---------------------------------------------------------------- R6-R9, J5
@register("response_check", _TEXTS + _RESP + "\nSELECT cache_key, response, is_valid FROM checked")
def response_check(spark, sf):
    recs = _ok_shared(spark, sf)
    return rp.response_check(_responses(recs)).select("cache_key", "response", "is_valid")


def _resolved(spark, sf):
    recs = _ok_shared(spark, sf)
    analyses = recs.select("l_suppkey", "sample", "tier", "cache_key", F.col("template_text").alias("template"))
    return rp.resolve_explanation(analyses, _responses(recs))


@register("resolve_explanation", _TEXTS + _RESP + "\nSELECT l_suppkey, sample, from_cache, explanation FROM resolved")
def resolve_explanation(spark, sf):
    return _resolved(spark, sf).select("l_suppkey", "sample", "from_cache", "explanation")


@register("action_extract", _TEXTS + _RESP + f"\nSELECT l_suppkey, sample, {_ACTION} AS action FROM resolved")
def action_extract(spark, sf):
    return _resolved(spark, sf).select("l_suppkey", "sample", "action")


@register("cache_lookup", _TEXTS + _RESP + """
SELECT l_suppkey, sample, cache_key FROM recs WHERE status = 'OK' AND cache_key IN (SELECT cache_key FROM cache)""")
def cache_lookup(spark, sf):
    recs = _ok_shared(spark, sf)
    cache = rp.valid_responses(_responses(recs)).select("cache_key")
    return recs.join(cache, "cache_key", "left_semi").select("l_suppkey", "sample", "cache_key")


@register("worklist_dedup", _TEXTS + _RESP + """
, pending AS (SELECT * FROM recs WHERE status = 'OK' AND cache_key NOT IN (SELECT cache_key FROM cache)),
firsts AS (SELECT cache_key, l_suppkey, sample,
                  row_number() OVER (PARTITION BY cache_key ORDER BY l_suppkey, sample) AS rn,
                  count(*) OVER (PARTITION BY cache_key) AS n_requests FROM pending)
SELECT cache_key, l_suppkey, sample, n_requests FROM firsts WHERE rn = 1""")
def worklist_dedup(spark, sf):
    recs = _ok_shared(spark, sf)
    analyses = recs.select("cache_key", "l_suppkey", "sample")
    wl = rp.worklist(analyses, _responses(recs), order=F.struct("l_suppkey", "sample"))
    return wl.select("cache_key", "l_suppkey", "sample", "n_requests")


# ---------------------------------------------------------------- R10 / W10
@register("history_line", _TEXTS + _RESP + f"""
SELECT l_suppkey, sample, 'Time: ' || strftime(l_shipdate, '%H:%M') || ' | Confidence: ' || {_PCT}
       || ' | Features: ' || concat_ws(', ', top1_variable, top2_variable, top3_variable)
       || ' | Action taken: ' || {_ACTION} AS line
FROM resolved WHERE confidence >= 0.5""")
def history_line(spark, sf):
    recs = _ok_shared(spark, sf, keep=("l_shipdate",))
    analyses = recs.select("l_suppkey", "sample", "tier", "cache_key", "l_shipdate", "confidence", "important_features",
                           F.col("template_text").alias("template"))
    res = rp.resolve_explanation(analyses, _responses(recs)).filter(F.col("confidence") >= 0.5)
    line = rp.history_line(F.col("l_shipdate"), F.col("confidence"), F.col("important_features"), F.col("action"))
    return res.select("l_suppkey", "sample", line.alias("line"))


@register("history_window", _TEXTS + """
, ok AS (SELECT * FROM recs WHERE status = 'OK')
SELECT l_suppkey, sample,
       CAST(count(*) OVER (PARTITION BY l_suppkey ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS INTEGER) AS n_history,
       lag(tier, 1) OVER (PARTITION BY l_suppkey ORDER BY sample) AS prev1_tier,
       lag(tier, 2) OVER (PARTITION BY l_suppkey ORDER BY sample) AS prev2_tier,
       lag(tier, 3) OVER (PARTITION BY l_suppkey ORDER BY sample) AS prev3_tier
FROM ok""")
def history_window(spark, sf):
    ok = _ok(spark, sf)
    h = rp.history_window(ok, ["l_suppkey"], "sample", F.struct("sample", "tier"), 3, chunks="auto")
    n = F.size("history")
    return h.select("l_suppkey", "sample", n.cast("int").alias("n_history"),
                    *[F.when(n >= k, F.element_at("history", -k)["tier"]).alias(f"prev{k}_tier") for k in (1, 2, 3)])


# ---------------------------------------------------------------- F11 feature description
@register("feature_description", _ESQL + """
, zl AS (""" + "\nUNION ALL\n".join(f"SELECT user_id, event_id, '{f}' AS feature, {q(f + '__z')} AS z FROM zrows" for f in E_FEATS) + """),
top AS (SELECT user_id, event_id, feature, row_number() OVER (PARTITION BY user_id, event_id ORDER BY z DESC, feature DESC) AS rn FROM zl)
SELECT user_id, event_id, feature, """ + feature_description_sql("feature", "'event value'") + """ AS description
FROM top WHERE rn = 1""")
def feature_description(spark, sf):
    from procsig.operators.detect import z_exprs
    s = events_scored(spark, sf)
    zs = z_exprs(s.zmodel, s.scaler)
    best = F.greatest(*[F.struct(z.alias("z"), F.lit(f).alias("feature")) for f, z in zs.items()])
    out = s.feats.select("user_id", "event_id", best["feature"].alias("feature"))
    return out.select("*", feature_description_expr(F.col("feature"), F.lit(VARIABLE_DESCRIPTIONS["value"])).alias("description"))
