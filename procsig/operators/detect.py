"""Scaler and z-score detector.

Fitting is one aggregation with map-side partial aggregation (a tiny shuffle of partial
buffers, whatever the data size). The fitted parameters are a handful of numbers per
feature; they are collected as one row and applied as literals, so scoring is a pure
projection inside whole-stage codegen — no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsig.functions.scalar import ZERO_STD_GUARD, logistic
from procsig.plans.guard import collect_bounded


def _m(f: str) -> str:
    return f"{f}__mean"


def _s(f: str) -> str:
    return f"{f}__std"


# ----------------------------------------------------------------- A21 moments

def column_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A21 as data: one row with mean and population std (ddof 0) of every feature."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(_m(f)), F.stddev_pop(f).alias(_s(f))]
    return df.agg(*aggs)


def moments_long(model: DataFrame, features: Sequence[str]) -> DataFrame:
    """One-row moments as (feature, mean, std) rows."""
    items = [F.struct(F.lit(f).alias("feature"), F.col(_m(f)).alias("mean"), F.col(_s(f)).alias("std"))
             for f in features]
    return model.select(F.inline(F.array(*items)))


@dataclass(frozen=True)
class Moments:
    """Fitted per-feature location and spread (a scaler or a z-score model)."""
    mean: Mapping[str, float]
    std: Mapping[str, float]

    @property
    def features(self) -> list[str]:
        return list(self.mean)


def _collect_one(df: DataFrame) -> dict:
    return collect_bounded(df, 1)[0].asDict()


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Moments:
    """A21 fit: population moments; a zero (or undefined) std becomes 1 like sklearn."""
    m = vector_moments(df, features)[0]
    std = {f: (s if s not in (None, 0.0) else 1.0) for f, s in zip(features, m["std"])}
    return Moments(dict(zip(features, m["mean"])), std)


def standardise(df: DataFrame, scaler: Moments) -> DataFrame:
    """(x - mean) / std for the fitted features; other columns unchanged."""
    out = []
    for c in df.columns:
        if c in scaler.mean:
            out.append(((F.col(c) - F.lit(scaler.mean[c])) / F.lit(scaler.std[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def zscore_fit_df(df: DataFrame, features: Sequence[str], normal: Column | None = None) -> DataFrame:
    """D2 as data: one row of mean / population std on normal rows, zero std -> 1e-6."""
    base = df.filter(normal) if normal is not None else df
    mom = column_moments(base, features)
    return mom.select(*[c for f in features for c in (
        F.col(_m(f)), F.when(F.col(_s(f)) == 0, F.lit(ZERO_STD_GUARD)).otherwise(F.col(_s(f))).alias(_s(f)))])


def fit_zscore(df: DataFrame, features: Sequence[str], normal: Column | None = None) -> Moments:
    """D2 fit on normal rows only."""
    row = _collect_one(zscore_fit_df(df, features, normal))
    return Moments({f: row[_m(f)] for f in features}, {f: row[_s(f)] for f in features})


def vector_moments(df: DataFrame, features: Sequence[str], weights: Sequence[Column | None] = (None,)) -> list[dict]:
    """Mean and population std of every feature, once per weight column (rows with weight 0
    skipped), from ``Summarizer`` aggregates over one assembled vector: a single pass, one
    aggregate function per weight whatever the number of features, numerically stable
    (streaming mean / M2 updates)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Summarizer
    cols = [F.col(f).cast("double").alias(f) for f in features]
    ws = [w.cast("double").alias(f"_w{i}") for i, w in enumerate(weights) if w is not None]
    vec = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df.select(*cols, *ws))
    summ = Summarizer.metrics("mean", "variance", "count")
    aggs = [(summ.summary(F.col("_v"), F.col(f"_w{i}")) if w is not None else summ.summary(F.col("_v"))).alias(f"s{i}")
            for i, w in enumerate(weights)]
    row = collect_bounded(vec.select(*aggs), 1)[0]
    out = []
    for i in range(len(weights)):
        r = row[f"s{i}"]
        n = int(r["count"])
        if n == 0:
            out.append({"n": 0, "mean": [None] * len(features), "std": [None] * len(features)})
            continue
        var = r["variance"].toArray().tolist()
        std = [max(v, 0.0) ** 0.5 * ((n - 1) / n) ** 0.5 if n > 1 else 0.0 for v in var]
        out.append({"n": n, "mean": r["mean"].toArray().tolist(), "std": std})
    return out


def fit_scaled_zscore(train: DataFrame, features: Sequence[str], normal: Column) -> tuple[Moments, Moments]:
    """A21 + D2: the scaler on all training rows and the z-score model of the
    *standardised* features on normal training rows.

    Standardising is affine, so the normal-row moments of (x - m) / s are (mu_n - m) / s
    and sigma_n / s: both fits come from raw-feature moments, two vector aggregates.
    Rows with a missing feature are skipped (fit on complete rows).
    """
    allm, nrm = vector_moments(train, features, [None, F.coalesce(normal, F.lit(False)).cast("int")])
    sm, ss, zm, zs = {}, {}, {}, {}
    for i, f in enumerate(features):
        m, sd = allm["mean"][i], allm["std"][i]
        s = sd if sd not in (None, 0.0) else 1.0
        sm[f], ss[f] = m, s
        nm, ns = nrm["mean"][i], nrm["std"][i]
        zm[f] = None if nm is None or m is None else (nm - m) / s
        z = None if ns is None else ns / s
        zs[f] = ZERO_STD_GUARD if z == 0 else z
    return Moments(sm, ss), Moments(zm, zs)


# ----------------------------------------------------------------- D3 / D4 / D5

def z_exprs(model: Moments, scaler: Moments | None = None) -> dict[str, Column]:
    """|z| per feature; with ``scaler`` the raw column is standardised first."""
    out = {}
    for f in model.features:
        x = F.col(f)
        if scaler is not None:
            x = (x - F.lit(scaler.mean[f])) / F.lit(scaler.std[f])
        out[f] = F.abs((x - F.lit(model.mean[f])) / F.lit(model.std[f]))
    return out


def zscore_score(df: DataFrame, model: Moments, threshold: float, scaler: Moments | None = None,
                 keep_z: bool = False) -> DataFrame:
    """D3 + D4: prediction = any |z| > threshold (strict, so z = t gives 0);
    confidence = logistic(max z - t) = P(anomaly)."""
    zs = z_exprs(model, scaler)
    mz = F.greatest(*zs.values()) if len(zs) > 1 else next(iter(zs.values()))
    extra = [z.alias(f"{f}__z") for f, z in zs.items()] if keep_z else []
    scored = df.select("*", *extra, mz.alias("max_z"))
    return scored.select(
        "*",
        (F.col("max_z") > F.lit(threshold)).cast("int").alias("prediction"),
        logistic(F.col("max_z") - F.lit(threshold)).alias("confidence"),
    )


def zscore_importance(model: Moments) -> dict[str, float]:
    """(1/std) / sum(1/std)."""
    inv = {f: 1.0 / abs(s) for f, s in model.std.items()}
    tot = sum(inv.values())
    return {f: v / tot for f, v in inv.items()}


def zscore_importance_df(fit_row: DataFrame, features: Sequence[str]) -> DataFrame:
    """D5 as data from a ``zscore_fit_df`` row: (feature, importance)."""
    inv = [F.struct(F.lit(f).alias("feature"), (F.lit(1.0) / F.abs(F.col(_s(f)))).alias("inv")) for f in features]
    total = None
    for f in features:
        t = F.lit(1.0) / F.abs(F.col(_s(f)))
        total = t if total is None else total + t
    return fit_row.select(F.inline(F.array(*inv)), total.alias("_tot")).select(
        "feature", (F.col("inv") / F.col("_tot")).alias("importance"))
