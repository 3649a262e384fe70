"""End-to-end analysis record (R11) over every series and sample at once.

sequence check (P10) -> serving features (W5) -> scaler fitted on the training series
(A21, D1) -> z-score fitted on normal training rows (D2) -> score (D3, D4) -> signed
contributions (R1) -> top bases per row (R2/R3) -> tier, context, template, cache key
(R4, R5, F14). Rows without three consecutive samples get ``status = 'ERROR'`` instead of
raising. Shuffles: one Exchange for the series windows and two tiny one-row aggregates
(scaler and z-score moments) that are broadcast back; everything else is projection.
"""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsig.operators import features as fe
from procsig.operators.detect import fit_scaled_zscore, z_exprs
from procsig.operators.explain import base_total_exprs, top_bases_expr
from procsig.operators.prepare import holdout_split
from procsig.operators.report import DEFAULT_TEMPLATES, with_alert_text
from procsig.functions.scalar import logistic
from procsig.session import cut_lineage_packed
from procsig.spec import SeriesSpec

ERROR_TEXT = "STATUS: ERROR - fewer than three consecutive samples end at this sample"


def serving_features(df: DataFrame, spec: SeriesSpec, variables: Sequence[str], sample: str = "sample",
                     length: int = 3, chunks: int = 1, stored: Sequence[str] | None = None, complete_only: bool = False) -> DataFrame:
    """Features plus ``seq_ok`` and ``ok`` for every row (no row dropped).

    ``chunks == 1``: one Exchange, one Sort, one Window. ``chunks > 1``: each series is cut
    into ordered ranges with two halo rows copied forward, so a series holding a large share
    of all rows is spread over many tasks (same result).

    ``stored`` names the columns to keep beside the variables when the features are read more than once: only lags are
    windows then, written once, compressed, and the other features are made of them at every read (same result).
    ``complete_only`` leaves out rows that cannot be ``ok`` before they are written.
    """
    def build(s: SeriesSpec):
        w = s.window()
        ok = F.col(sample) >= length
        for k in range(1, length):
            ok = ok & (F.lag(F.col(sample), k).over(w) == F.col(sample) - k)
        more = fe.rolling_exprs(s, variables, (3,)) + fe.diff_exprs(s, variables) if stored is None else []
        return fe.lag_exprs(s, variables, (1, 2)) + more + [F.coalesce(ok, F.lit(False)).alias("seq_ok")]

    base = spec.drop_null_keys(df)
    if chunks > 1:
        if stored is not None:  # read for ranges, sizes, halos and rows
            base = cut_lineage_packed(base.select(*dict.fromkeys([*stored, *spec.order, *variables])))
        out = fe.chunked_window(base, spec, max(2, length - 1), build, chunks)
    else:
        out = base.select("*", *build(spec))
    if stored is not None:
        if complete_only:
            for c in [*variables, *[fe.lag_name(v, k) for v in variables for k in (1, 2)]]:
                out = out.where(F.col("seq_ok") & F.col(c).isNotNull() & ~F.isnan(c))
        return _stored_features(out, stored, variables)
    names = fe.feature_names(variables)
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull() & ~F.isnan(F.col(n))
    return out.select("*", (F.col("seq_ok") & complete).alias("ok"))


def _stored_features(lagged: DataFrame, kept: Sequence[str], variables: Sequence[str]) -> DataFrame:
    lags = [fe.lag_name(v, k) for v in variables for k in (1, 2)]
    names = fe.feature_names(variables)
    read = [*kept, *variables, *lags]

    def add(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = {c: b.column(c) for c in read}
        for v in variables:
            cols |= fe.rolling_of_lags(b, v)
        for v in variables:
            x, lag = b.column(v), b.column(fe.lag_name(v, 1))
            diff = x.to_numpy(zero_copy_only=False).astype(float) - lag.to_numpy(zero_copy_only=False).astype(float)
            cols[fe.diff_name(v)] = fe.double_array(diff, ~np.asarray(x.is_valid()) | ~np.asarray(lag.is_valid()))
        ok = np.asarray(b.column("seq_ok").to_numpy(zero_copy_only=False), dtype=bool)
        for n in names:
            ok = ok & ~np.isnan(cols[n].to_numpy(zero_copy_only=False).astype(float))  # a missing value is NaN here
        cols |= {"seq_ok": b.column("seq_ok"), "ok": pa.array(ok)}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    made = [fe.rolling_name(v, s, 3) for v in variables for s in fe.ROLLING_STATS] + [fe.diff_name(v) for v in variables]
    schema = T.StructType([lagged.schema[c] for c in read] + [T.StructField(c, T.DoubleType()) for c in made]
                          + [T.StructField(c, T.BooleanType()) for c in ("seq_ok", "ok")])
    return cut_lineage_packed(lagged.select(*read, "seq_ok"), add, schema)


def analysis_records(samples: DataFrame, spec: SeriesSpec, variables: Sequence[str], label: str = "label",
                     sample: str = "sample", threshold: float = 3.0, top_n: int = 3,
                     descriptions: Mapping[str, str] | None = None, train_fraction: float = 0.8,
                     templates: Mapping[str, str] = DEFAULT_TEMPLATES, keep: Sequence[str] = (),
                     chunks: int = 1, cut: float | None = None) -> DataFrame:
    """One record per (series, sample): status, prediction, confidence, top variables, texts.

    ``cut`` is the bound of the training series where the caller knows it (else it is read from the feature rows).

    ``keep`` names input columns carried through unchanged (e.g. a timestamp).
    """
    names = fe.feature_names(variables)
    feats = serving_features(samples, spec, variables, sample, chunks=chunks,
                             stored=[*dict.fromkeys([*spec.keys, sample, label, *keep])] if chunks > 1 else None)
    series = spec.keys[0]
    feats = holdout_split(feats, series, train_fraction, cut=cut)
    train_ok = feats.filter(F.col("ok") & (F.col("split") == "train"))
    scaler, zmodel = fit_scaled_zscore(train_ok, names, normal=~F.col(label))
    zs = z_exprs(zmodel, scaler)
    groups = {v: [n for n in names if n == v or n.startswith(v + "_")] for v in variables}
    # z columns get their own projection: each is then computed once, and the later
    # projection (max, contributions, sorting) stays small enough for whole-stage codegen
    zcols = feats.select(*spec.keys, sample, label, "split", "ok", *keep,
                         *[z.alias(f"{f}__z") for f, z in zs.items()])
    scored = zcols.select(
        *spec.keys, sample, label, "split", "ok", *keep,
        (F.greatest(*[F.col(f"{f}__z") for f in names]) if len(names) > 1 else F.col(f"{names[0]}__z")).alias("max_z"),
        *[(F.col(f"{f}__z") - F.lit(threshold)).alias(f"{f}__c") for f in names],
    )
    cmap = {f: f"{f}__c" for f in names}
    totals = base_total_exprs(cmap, groups)
    scored = scored.select(*spec.keys, sample, label, "split", "ok", *keep, "max_z",
                           *[t.alias(f"{b}__total") for b, t in totals.items()])
    top = top_bases_expr({b: f"{b}__total" for b in totals}, top_n, descriptions)
    rec = scored.select(
        *spec.keys, F.col(sample).cast("int").alias(sample), label, "split", *keep,
        F.when(F.col("ok"), "OK").otherwise("ERROR").alias("status"),
        F.when(F.col("ok"), F.col("max_z")).alias("max_z"),
        F.when(F.col("ok"), (F.col("max_z") > F.lit(threshold)).cast("int")).alias("prediction"),
        F.when(F.col("ok"), logistic(F.col("max_z") - F.lit(threshold))).alias("confidence"),
        F.when(F.col("ok"), top).alias("important_features"),
    )
    rec = with_alert_text(rec, "confidence", "important_features", templates)
    return rec.select(
        *[c for c in rec.columns if c not in ("tier", "context", "template", "cache_key")],
        F.when(F.col("status") == "OK", F.col("tier")).alias("tier"),
        F.when(F.col("status") == "OK", F.col("context")).alias("context"),
        F.when(F.col("status") == "OK", F.col("template")).otherwise(F.lit(ERROR_TEXT)).alias("explanation"),
        F.when(F.col("status") == "OK", F.col("cache_key")).alias("cache_key"),
    )


def flatten_top(df: DataFrame, n: int = 3, col: str = "important_features") -> DataFrame:
    """Flat ``top{i}_variable`` / ``top{i}_score`` columns (for SQL comparison)."""
    extra = []
    for i in range(n):
        extra += [F.col(col)[i]["variable_name"].alias(f"top{i + 1}_variable"),
                  F.col(col)[i]["importance_score"].alias(f"top{i + 1}_score")]
    return df.select(*[c for c in df.columns if c != col], *extra)
