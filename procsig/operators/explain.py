"""Attribution.

Two forms:

* row-wise (``base_totals`` / ``top_bases``): per-row sums over the feature catalog and a
  sorted array of structs, all inside one projection — no unpivot, no shuffle. This is the
  path used by the analysis record, because attribution is independent per row.
* long (``attribution_by_base`` / ``top_variables`` / ``format_attribution``): for contributions that
  already come as ``(row ids, feature, contribution)`` rows; grouped aggregation + ranking window. The
  same operators take contributions that still lie in their row (``zscore_contributions(wide=True)``): columns
  ``{feature}__c``, then ``{base}__total``, then an array ``top``; nothing is exploded or shuffled.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsig.functions.scalar import round_half_even
from procsig.operators.detect import Moments, z_exprs
from procsig.plans.guard import bounded_broadcast, collect_bounded


# ----------------------------------------------------------------- R1 contributions

def zscore_contribution_exprs(model: Moments, threshold: float, scaler: Moments | None = None) -> dict[str, Column]:
    """R1 for the z-score model: signed excess |z| - threshold per feature.

    Positive values push the row towards "anomaly" on their own; negative ones towards normal.
    """
    return {f: z - F.lit(threshold) for f, z in z_exprs(model, scaler).items()}


def zscore_contributions(df: DataFrame, model: Moments, threshold: float, row_cols: Sequence[str],
                         scaler: Moments | None = None, wide: bool = False) -> DataFrame:
    """R1 long form: (row ids, feature, contribution); ``wide``: one row per row with a column ``{feature}__c`` for each.
    Wide rows need not be unique in ``row_cols``: each keeps its own attribution."""
    exprs = zscore_contribution_exprs(model, threshold, scaler)
    if wide:
        return df.select(*row_cols, *[e.alias(f"{f}__c") for f, e in exprs.items()])
    items = [F.struct(F.lit(f).alias("feature"), e.alias("contribution")) for f, e in exprs.items()]
    return df.select(*row_cols, F.inline(F.array(*items)))


def linear_contributions(df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float],
                         row_cols: Sequence[str]) -> DataFrame:
    """R1 for a linear model: w * (x - mean(x)) (exact SHAP for independent features).

    An undefined weight (e.g. a constant feature) gives a NULL contribution."""
    def lit(v):
        return F.lit(None).cast("double") if v is None else F.lit(float(v))
    items = [F.struct(F.lit(f).alias("feature"), (lit(w) * (F.col(f) - lit(means[f]))).alias("contribution"))
             for f, w in weights.items()]
    return df.select(*row_cols, F.inline(F.array(*items)))


def diagonal_discriminant(train: DataFrame, features: Sequence[str], label: str = "label") -> tuple[dict, dict]:
    """A linear model fitted in one aggregate: w_f = (mean_pos - mean_neg) / var_pop and the
    training means (one small row collected; bounded by the number of features)."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f)
        aggs += [((F.avg(F.when(F.col(label), x)) - F.avg(F.when(~F.col(label), x))) /
                  F.nullif(F.var_pop(x), F.lit(0.0))).alias(f"w{i}"), F.avg(x).alias(f"m{i}")]
    r = collect_bounded(train.agg(*aggs), 1)[0]
    return ({f: r[f"w{i}"] for i, f in enumerate(features)}, {f: r[f"m{i}"] for i, f in enumerate(features)})


# ----------------------------------------------------------------- long form

def attribution_by_base(contrib: DataFrame, catalog: DataFrame, row_cols: Sequence[str],
                        max_catalog_rows: int = 100_000) -> DataFrame:
    """Signed sum of contributions over each base variable's derived features.

    Long: ``row_cols, base, total``. Wide contributions: ``row_cols`` and a column ``{base}__total`` for each base, summed in the row.
    """
    if "feature" not in contrib.columns:
        rows = collect_bounded(catalog.select("feature", "base"), max_catalog_rows)
        groups = base_groups([(r["feature"], r["base"]) for r in rows if f"{r['feature']}__c" in contrib.columns])
        totals = []
        for base, feats in groups.items():
            cols = [F.col(f"{f}__c") for f in feats]
            total = F.coalesce(cols[0], F.lit(0.0))  # as the aggregate: NULLs are skipped, NULLs alone give NULL
            for c in cols[1:]:
                total = total + F.coalesce(c, F.lit(0.0))
            totals.append(F.when(F.coalesce(*cols).isNotNull(), total).alias(f"{base}__total"))
        return contrib.select(*row_cols, *totals)
    cat = bounded_broadcast(catalog.select("feature", "base"), max_catalog_rows)
    return (contrib.join(cat, "feature", "inner")
            .groupBy(*row_cols, "base").agg(F.sum("contribution").alias("total")))


def _wide_totals(totals: DataFrame) -> list[tuple[str, Column]]:
    return [(c.removesuffix("__total"), F.col(c)) for c in totals.columns if c.endswith("__total")]


def long_totals(totals: DataFrame, row_cols: Sequence[str]) -> DataFrame:
    """Wide totals as (row ids, base, total) rows: a generator over the row, no shuffle."""
    return totals.select(*row_cols, F.inline(F.array(*[F.struct(F.lit(b).alias("base"), t.alias("total")) for b, t in _wide_totals(totals)])))


def top_variables(totals: DataFrame, row_cols: Sequence[str], n: int = 3,
                  dim: DataFrame | None = None, max_dim_rows: int = 100_000) -> DataFrame:
    """W9 + J1: top-n bases per row by signed total (desc, ties by name), with descriptions.

    Long: ``row_cols, base, total, rank, description``. Wide totals: ``row_cols, top``, an array of these, sorted in the row.
    """
    if "base" not in totals.columns:
        # ascending keys: NULL last, NaN first, total descending, name
        keyed = F.array(*[F.struct(
            t.isNull().alias("none"), (~F.coalesce(F.isnan(t), F.lit(False))).alias("number"), (-t).alias("down"),
            F.lit(b).alias("base"), t.alias("total")) for b, t in _wide_totals(totals)])
        text = variable_descriptions(dim, max_dim_rows) if dim is not None else {}
        told = F.create_map(*[F.lit(y) for kv in text.items() for y in kv]) if text else None
        return totals.select(*row_cols, F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x, i: F.struct(
            (i + 1).alias("rank"), x["base"].alias("base"), x["total"].alias("total"),
            (told[x["base"]] if told is not None else F.lit(None).cast("string")).alias("description"))).alias("top"))
    w = Window.partitionBy(*row_cols).orderBy(F.col("total").desc(), F.col("base"))
    ranked = totals.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)
    if dim is not None:
        d = bounded_broadcast(dim.select("base", "description"), max_dim_rows)
        ranked = ranked.join(d, "base", "left")
    return ranked


def unknown_bases(totals: DataFrame, dim: DataFrame) -> DataFrame:
    """J1 check: base variables with no description (the reference raises KeyError)."""
    return totals.select("base").distinct().join(dim.select("base"), "base", "left_anti")


def format_attribution(top: DataFrame, row_cols: Sequence[str], digits: int = 4) -> DataFrame:
    """Ordered ``ARRAY<STRUCT<variable_name, description, importance_score>>`` per row.

    Each group holds at most n rows, so the collected list is bounded. An array ``top`` is formatted in its row.
    """
    if "top" in top.columns:
        return top.select(*row_cols, F.transform("top", lambda x: F.struct(
            x["base"].alias("variable_name"), x["description"].alias("description"),
            round_half_even(x["total"], digits).alias("importance_score"))).alias("important_features"))
    item = F.struct(F.col("rank"), F.col("base").alias("variable_name"), F.col("description"),
                    round_half_even(F.col("total"), digits).alias("importance_score"))
    agg = top.groupBy(*row_cols).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return agg.select(*row_cols, F.transform("_items", lambda x: F.struct(
        x["variable_name"].alias("variable_name"), x["description"].alias("description"),
        x["importance_score"].alias("importance_score"))).alias("important_features"))


# ----------------------------------------------------------------- row-wise form (R2 fast path)

def base_groups(catalog_rows: Sequence[tuple[str, str]]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for feature, base in catalog_rows:
        groups.setdefault(base, []).append(feature)
    return groups


def base_total_exprs(contrib_cols: Mapping[str, str], groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Per-row signed total of each base's contribution columns (plain column sums)."""
    out = {}
    for base, feats in groups.items():
        s = None
        for f in feats:
            c = F.col(contrib_cols[f])
            s = c if s is None else s + c
        out[base] = s
    return out


def top_bases_expr(total_cols: Mapping[str, str], n: int, descriptions: Mapping[str, str] | None = None,
                   digits: int | None = 4) -> Column:
    """R2 inside one projection: sort the bases of a row by total and keep n.

    ``total_cols`` maps base -> column holding its total. Sorting an array of
    ``struct(-total, name)`` ascending gives total descending (signed, so bases pushing
    towards normal rank last) and then name ascending, with no comparator lambda.
    """
    arr = F.array(*[F.struct((-F.col(c)).alias("neg_total"), F.lit(b).alias("variable_name"))
                    for b, c in total_cols.items()])
    top = F.slice(F.array_sort(arr), 1, n)
    desc_map = None
    if descriptions:
        kv = []
        for k, v in descriptions.items():
            kv += [F.lit(k), F.lit(v)]
        desc_map = F.create_map(*kv)
    return F.transform(top, lambda x: F.struct(
        x["variable_name"].alias("variable_name"),
        (desc_map[x["variable_name"]] if desc_map is not None else F.lit(None).cast("string")).alias("description"),
        (round_half_even(-x["neg_total"], digits) if digits is not None else -x["neg_total"]).alias("importance_score")))


def explode_top(df: DataFrame, keep: Sequence[str], top: Column) -> DataFrame:
    """R2/W9 long output from a row-wise top-n array: one (keep..., rank, base, description,
    total) row per entry, ranks 1..n. A generator over the row: no shuffle, no window."""
    return df.select(*keep, F.posexplode(top).alias("_pos", "_t")).select(
        *keep, (F.col("_pos") + 1).alias("rank"), F.col("_t.variable_name").alias("base"),
        F.col("_t.description").alias("description"), F.col("_t.importance_score").alias("total"))


def variable_descriptions(dim: DataFrame, max_rows: int = 10_000) -> dict[str, str]:
    """Small dimension (base, description) as a dict, refused above ``max_rows`` rows."""
    return {r["base"]: r["description"] for r in collect_bounded(dim.select("base", "description"), max_rows)}
