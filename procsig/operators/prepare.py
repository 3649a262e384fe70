"""Projection, filters, labelling, splits and unions.

All are narrow transformations (no shuffle) except the positional slice, which needs a
row number inside each series. Filters on plain columns reach the Parquet scan as
``PushedFilters``.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsig.spec import SeriesSpec


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ordered column subset."""
    return df.select(*columns)


def columns_with_prefix(df: DataFrame, prefixes: Iterable[str]) -> list[str]:
    prefixes = tuple(prefixes)
    return [c for c in df.columns if c.startswith(prefixes)]


def select_prefixed(df: DataFrame, prefixes: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep columns whose name starts with any prefix (derived columns included)."""
    return df.select(*keep, *[c for c in columns_with_prefix(df, prefixes) if c not in keep])


def select_regex(df: DataFrame, pattern: str) -> DataFrame:
    """P2 via a regular expression on column names."""
    rx = re.compile(pattern)
    return df.select(*[c for c in df.columns if rx.search(c)])


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast named columns, keep the rest."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def onset_label(df: DataFrame, fault: str | Column, sample: str | Column, onset: Column | int,
                name: str = "faulty") -> DataFrame:
    """faulty = fault > 0 AND sample > onset (strict)."""
    f = F.col(fault) if isinstance(fault, str) else fault
    s = F.col(sample) if isinstance(sample, str) else sample
    o = F.lit(onset) if isinstance(onset, int) else onset
    return df.select("*", ((f > 0) & (s > o)).alias(name))


def split_onset(split: str = "split", training: int = 20, testing: int = 160) -> Column:
    """Onset sample per split: 20 for training data, 160 for testing data."""
    return F.when(F.col(split) == "training", F.lit(training)).otherwise(F.lit(testing))


def filter_members(df: DataFrame, column: str, values: Sequence, cap_column: str | None = None,
                   cap: int | None = None) -> DataFrame:
    """``column IN values AND cap_column <= cap`` (pushed into the scan)."""
    cond = F.col(column).isin(list(values))
    if cap_column is not None:
        cond = cond & (F.col(cap_column) <= cap)
    return df.filter(cond)


def slice_series(df: DataFrame, conditions: dict[str, object], caps: dict[str, object] | None = None) -> DataFrame:
    """Equality on some columns, ``<=`` caps on others."""
    cond = F.lit(True)
    for c, v in conditions.items():
        cond = cond & (F.col(c) == v)
    for c, v in (caps or {}).items():
        cond = cond & (F.col(c) <= v)
    return df.filter(cond)


def normal_subset(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows labelled normal."""
    return df.filter(~F.col(label))


def positional_slice(df: DataFrame, spec: SeriesSpec, start: int, stop: int, name: str = "pos",
                     chunks: int | str = 1) -> DataFrame:
    """``iloc[start:stop]`` inside each series by explicit order (0-based, stop exclusive).

    ``chunks > 1`` numbers big series in parallel ranges (exact offsets)."""
    from procsig.operators.features import with_sample_number
    numbered = with_sample_number(df, spec, "_rn", chunks=chunks)
    return numbered.select(*df.columns, (F.col("_rn") - 1).alias(name)).filter(
        (F.col(name) >= start) & (F.col(name) < stop))


def analysis_sequence_check(df: DataFrame, spec: SeriesSpec, sample: str = "sample", length: int = 3,
                            chunks: int | str = 1) -> DataFrame:
    """P10 batch form: for every row t, are samples t-1 .. t-(length-1) the previous rows?

    Adds ``seq_ok``: True when the ``length`` consecutive samples ending at this row exist,
    so every (series, t) gets a status instead of an assertion. ``chunks > 1`` (or ``"auto"``) spreads big
    series over ordered ranges with ``length - 1`` halo rows (same result).
    """
    from procsig.operators.features import windowed

    def build(s: SeriesSpec):
        w = s.window()
        ok = F.col(sample) >= length
        for k in range(1, length):
            ok = ok & (F.lag(F.col(sample), k).over(w) == F.col(sample) - k)
        return [F.coalesce(ok, F.lit(False)).alias("seq_ok")]

    return windowed(df, spec, length - 1, build, chunks)


def analysis_window(df: DataFrame, keys: dict[str, object], target: int, sample: str = "sample",
                    length: int = 3) -> DataFrame:
    """P10 single request: rows of one series with sample in [target-length+1, target]."""
    if target < length - 1:
        raise ValueError(f"target sample must be >= {length - 1}")
    cond = F.col(sample).between(target - length + 1, target)
    for c, v in keys.items():
        cond = cond & (F.col(c) == v)
    return df.filter(cond)


def holdout_cut(df: DataFrame, series: str, train_fraction: float = 0.8) -> float:
    """Series-id bound ``min + fraction * (max - min)`` from one tiny aggregate row."""
    r = df.agg(F.min(series).alias("lo"), F.max(series).alias("hi")).first()
    if r["lo"] is None:
        return 0.0
    return float(r["lo"]) + train_fraction * (float(r["hi"]) - float(r["lo"]))


def holdout_split(df: DataFrame, series: str, train_fraction: float = 0.8, name: str = "split",
                  cut: float | None = None) -> DataFrame:
    """Whole series only; ids up to the cut train, the rest validation (a projection)."""
    if cut is None:
        cut = holdout_cut(df, series, train_fraction)
    return df.select("*", F.when(F.col(series) <= F.lit(cut), "train").otherwise("validation").alias(name))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop a row when any (or any listed) column is NULL or NaN."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def head_after(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """T4: the first ``n`` rows after an explicit order."""
    return df.orderBy(*order).limit(n)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN becomes NULL in every floating column, so aggregates skip it."""
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            out.append(F.when(F.isnan(F.col(c)), F.lit(None).cast(t)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Stack frames by column name (missing columns filled with NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required - present, in required order (schema-level, no data touched)."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def missing_columns_df(spark, df: DataFrame, required: Sequence[str]) -> DataFrame:
    """U3 as data: required names anti-joined with the present ones."""
    req = spark.createDataFrame([(c,) for c in required], "column_name string")
    have = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    return req.join(have, "column_name", "left_anti")
