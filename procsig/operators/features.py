"""Windowed temporal features per series.

All expressions of one stage go into a single ``select`` so Catalyst plans one Exchange,
one Sort and one Window for every lag / rolling / diff column of that stage. Keys never
leak: every window is partitioned by the series keys, and rows with a NULL key are dropped
(they belong to no series).
"""

from __future__ import annotations

from typing import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsig.functions.scalar import with_count_below
from procsig.plans.guard import bounded_broadcast
from procsig.session import cut_lineage, release
from procsig.spec import SeriesSpec

ROLLING_STATS = ("mean", "std", "min", "max")


def lag_name(c: str, k: int) -> str:
    return f"{c}_lag_{k}"


def rolling_name(c: str, stat: str, w: int) -> str:
    return f"{c}_rolling_{stat}_{w}"


def diff_name(c: str) -> str:
    return f"{c}_diff"


def _columns(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else spec.numeric_columns(df)


def lag_exprs(spec: SeriesSpec, columns: Iterable[str], lags: Iterable[int]) -> list[Column]:
    w = spec.window()
    out = []
    for c in columns:
        for k in lags:
            if k > 0:
                e = F.lag(F.col(c), k).over(w)
            elif k < 0:
                e = F.lead(F.col(c), -k).over(w)
            else:
                e = F.col(c)
            out.append(e.alias(lag_name(c, k)))
    return out


def rolling_exprs(spec: SeriesSpec, columns: Iterable[str], windows: Iterable[int],
                  stats: Iterable[str] = ROLLING_STATS) -> list[Column]:
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    out = []
    for c in columns:
        for w in windows:
            if w < 1:
                raise ValueError("window size must be >= 1")
            frame = spec.frame(-(w - 1), 0)
            for s in stats:
                out.append(agg[s](F.col(c)).over(frame).alias(rolling_name(c, s, w)))
    return out


def diff_exprs(spec: SeriesSpec, columns: Iterable[str]) -> list[Column]:
    w = spec.window()
    return [(F.col(c) - F.lag(F.col(c), 1).over(w)).alias(diff_name(c)) for c in columns]


def rolling_of_lags(b: pa.RecordBatch, c: str) -> dict[str, pa.Array]:
    """W2 over three rows from a value and its two lags, to the last bit as the window has it (missing values and rows
    before the series are skipped, sums and moments grow from the oldest row)."""
    names = (lag_name(c, 2), lag_name(c, 1), c)
    n, avg, m2, total, low, high = (np.zeros(b.num_rows) for _ in range(6))
    whole = not any(b.column(k).null_count for k in names)
    with np.errstate(all="ignore"):
        for k, col in enumerate(names):
            v = b.column(col).to_numpy(zero_copy_only=False).astype(float)
            if whole and not np.isnan(v).any():
                low = v if k == 0 else np.where((v < low) | np.isnan(low), v, low)
                high = v if k == 0 else np.where(v > high, v, high)
                n, d = n + 1.0, v - avg
                step = d / n
                avg, m2, total = avg + step, m2 + d * (d - step), total + v
                continue
            there = np.asarray(b.column(col).is_valid())
            first = there & (n == 0)
            low = np.where(first | there & ((v < low) | np.isnan(low)), v, low)
            high = np.where(first | there & ((v > high) | np.isnan(v)), v, high)
            n = n + there
            d = v - avg
            step = d / n
            avg, m2, total = np.where(there, avg + step, avg), np.where(there, m2 + d * (d - step), m2), np.where(there, total + v, total)
        out = {"mean": (total / n, n < 1), "std": (np.sqrt(m2 / (n - 1)), n < 2), "min": (low, n < 1), "max": (high, n < 1)}
    return {rolling_name(c, k, 3): double_array(v, none) for k, (v, none) in out.items()}


def double_array(v: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(v, pa.float64(), mask=none)


def _finish(df: DataFrame, dropna: bool) -> DataFrame:
    # The reference drops a row when ANY column is missing, not only the new ones.
    return df.na.drop("any") if dropna else df


def windowed(df: DataFrame, spec: SeriesSpec, halo: int, build, chunks: int | str, ahead: int = 0) -> DataFrame:
    """One window per series, or ordered chunks of hot series: ``chunks`` ranges per series, or
    ``"auto"`` for as many as the largest series asks for (``series_chunks``). Same result."""
    n = series_chunks(df, spec) if chunks == "auto" else chunks
    return chunked_window(df, spec, halo, build, n, ahead) if n > 1 else df.select("*", *build(spec))


def lag_features(df: DataFrame, spec: SeriesSpec, lags: Sequence[int] = (1,),
                 columns: Sequence[str] | None = None, dropna: bool = True, chunks: int | str = 1) -> DataFrame:
    """``{c}_lag_{k}``; negative k looks ahead (lead). ``columns=None``: every numeric column but keys and order."""
    cols = _columns(df, spec, columns)
    df = spec.drop_null_keys(df)
    back, ahead = max([0, *lags]), max([0, *(-k for k in lags)])
    return _finish(windowed(df, spec, back, lambda s: lag_exprs(s, cols, lags), chunks, ahead), dropna)


def rolling_features(df: DataFrame, spec: SeriesSpec, windows: Sequence[int] = (3,),
                     columns: Sequence[str] | None = None, dropna: bool = True,
                     stats: Sequence[str] = ROLLING_STATS, chunks: int | str = 1) -> DataFrame:
    """Trailing ``w``-row mean / sample std / min / max, at least one row per frame."""
    cols = _columns(df, spec, columns)
    df = spec.drop_null_keys(df)
    return _finish(windowed(df, spec, max(windows) - 1, lambda s: rolling_exprs(s, cols, windows, stats), chunks), dropna)


def diff_features(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] | None = None,
                  dropna: bool = True, chunks: int | str = 1) -> DataFrame:
    """First difference ``{c}_diff``."""
    cols = _columns(df, spec, columns)
    df = spec.drop_null_keys(df)
    return _finish(windowed(df, spec, 1, lambda s: diff_exprs(s, cols), chunks), dropna)


def feature_chain_train(df: DataFrame, spec: SeriesSpec, columns: Sequence[str],
                        lags: Sequence[int] = (1, 2), windows: Sequence[int] = (3,), chunks: int | str = 1) -> DataFrame:
    """Lag -> drop -> rolling -> drop -> diff -> drop (later stages see fewer rows)."""
    n = series_chunks(df, spec) if chunks == "auto" else chunks
    out = lag_features(df, spec, lags, columns, dropna=True, chunks=n)
    out = rolling_features(out, spec, windows, columns, dropna=True, chunks=n)
    return diff_features(out, spec, columns, dropna=True, chunks=n)


def feature_chain_serving(df: DataFrame, spec: SeriesSpec, columns: Sequence[str],
                          lags: Sequence[int] = (1, 2), windows: Sequence[int] = (3,), chunks: int | str = 1) -> DataFrame:
    """All features from the same input rows in one select, one drop at the end."""
    df = spec.drop_null_keys(df)

    def build(s: SeriesSpec):
        return lag_exprs(s, columns, lags) + rolling_exprs(s, columns, windows) + diff_exprs(s, columns)

    return windowed(df, spec, max(*lags, *(w - 1 for w in windows), 1), build, chunks).na.drop("any")


def feature_names(columns: Sequence[str], lags: Sequence[int] = (1, 2), windows: Sequence[int] = (3,),
                  stats: Sequence[str] = ROLLING_STATS, include_base: bool = True) -> list[str]:
    names = list(columns) if include_base else []
    for c in columns:
        names += [lag_name(c, k) for k in lags]
    for c in columns:
        names += [rolling_name(c, s, w) for w in windows for s in stats]
    names += [diff_name(c) for c in columns]
    return names


def feature_catalog(spark, columns: Sequence[str], lags: Sequence[int] = (1, 2),
                    windows: Sequence[int] = (3,), stats: Sequence[str] = ROLLING_STATS) -> DataFrame:
    """(feature, base, transform, param): replaces parsing base names out of feature names."""
    rows = []
    for c in columns:
        rows.append((c, c, "value", None))
        rows += [(lag_name(c, k), c, "lag", int(k)) for k in lags]
        rows += [(rolling_name(c, s, w), c, f"rolling_{s}", int(w)) for w in windows for s in stats]
        rows.append((diff_name(c), c, "diff", 1))
    schema = T.StructType([
        T.StructField("feature", T.StringType(), False),
        T.StructField("base", T.StringType(), False),
        T.StructField("transform", T.StringType(), False),
        T.StructField("param", T.IntegerType(), True),
    ])
    return spark.createDataFrame(rows, schema)


def series_chunks(df: DataFrame, spec: SeriesSpec, target_rows: int = 5_000_000) -> int:
    """Checked size for the hot-series paths: rows of the largest series (one aggregate with
    map-side partial counts) divided by ``target_rows``, so a series holding a large share
    of all rows is cut into ranges of about ``target_rows``, however many that takes; 1 when
    every series is small."""
    g = df.groupBy(*spec.keys) if spec.keys else df.groupBy()
    largest = g.agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return int(max(1, -(-largest // target_rows)))


def spread_series(df: DataFrame, spec: SeriesSpec, target_rows: int = 250_000) -> DataFrame:
    """The rows shuffled by series into as many partitions as their number asks for (no second shuffle: windows
    over the series use this one), so that a partition of wide features stays small however many rows there
    are. Unchanged when the session's number of shuffle partitions is enough, or without keys."""
    if not spec.keys:
        return df
    n = -(-df.count() // target_rows)
    return df.repartition(n, *spec.keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def with_sample_number(df: DataFrame, spec: SeriesSpec, name: str = "sample", chunks: int | str = 1) -> DataFrame:
    """Integer time step 1..n inside each series, from the explicit order key.

    ``chunks > 1`` (or ``"auto"``, by measured size) numbers big series in parallel ranges
    (exact; see ``chunked_row_number``).
    """
    chunks = series_chunks(df, spec) if chunks == "auto" else chunks
    if chunks > 1:
        return chunked_row_number(chunk_tags(df, spec, chunks), spec, name).drop("_chunk")
    return df.select("*", F.row_number().over(spec.window()).alias(name))


# --------------------------------------------------------------------------------------
# W7 — windows over one huge series (global or hot key) without a single-task partition
# --------------------------------------------------------------------------------------

def chunk_tags(df: DataFrame, spec: SeriesSpec, n_chunks: int, halo: int = 1,
               max_hot_series: int = 10_000) -> DataFrame:
    """Add ``_chunk``: the range of the first order column a row falls in, per series.

    Boundaries come from ``percentile_approx`` per series, as accurate as ``n_chunks`` asks for.
    Ties on the first order column always share a chunk, so chunks of one series are ordered
    ranges. Only series worth splitting (8 rows per chunk and halo row) have boundaries; that
    table is broadcast under its checked size, so rows of a hot series are tagged where they lie
    and are never gathered on the series key first. Other series keep one chunk.
    """
    first = spec.order[0]
    keys = list(spec.keys)
    probs = [i / n_chunks for i in range(1, n_chunks)]
    accuracy = max(1_000, 8 * n_chunks)
    g = df.groupBy(*keys) if keys else df.groupBy()
    bounds = g.agg(F.count(F.lit(1)).alias("_n"),
                   F.array_distinct(F.percentile_approx(F.col(first), probs, accuracy)).alias("_b"))
    bounds = bounds.filter(F.col("_n") >= F.lit(8 * n_chunks * max(halo, 1))).select(*keys, F.col("_b").alias("_bounds"))
    none = F.array().cast(bounds.schema["_bounds"].dataType)
    if keys:
        bounds = bounded_broadcast(cut_lineage(bounds), max(max_hot_series, 4_000_000 // n_chunks))
        release(df.sparkSession)  # the partial quantiles are as large as the order column
        joined = df.join(bounds, keys, "left").withColumn("_bounds", F.coalesce("_bounds", none))
        return with_count_below(joined, F.col("_bounds"), F.col(first), n_chunks, "_chunk", inclusive=True).select(
            *df.columns, "_chunk")
    # one global series: its n_chunks - 1 boundaries become a literal array
    row = bounds.first()
    lits = (row["_bounds"] if row else None) or []
    arr = F.array(*[F.lit(v) for v in lits]) if lits else none
    return with_count_below(df, arr, F.col(first), n_chunks, "_chunk", inclusive=True).select(*df.columns, "_chunk")


def windowed_chunks(tagged: DataFrame, spec: SeriesSpec, halo: int, build, ahead: int = 0) -> DataFrame:
    """Evaluate window expressions chunk by chunk: the last ``halo`` rows before each chunk and the
    first ``ahead`` rows behind it are copied into it, every chunk is windowed independently under
    ``spec.with_extra('_chunk')`` and the copies are dropped again.

    The rows next to a chunk may lie in several chunks when some of them are shorter than the halo: each
    chunk's last (first) rows are tagged with their place in the series (chunk sizes, a small table, give
    the places) and go to every later (earlier) chunk that they are within ``halo`` (``ahead``) rows of.
    """
    if halo < 0 or ahead < 0:
        raise ValueError("halo and ahead must be >= 0")
    keys = list(spec.keys)
    cols = [c for c in tagged.columns if c != "_chunk"]
    chunk_spec = spec.with_extra("_chunk")
    own = tagged.select(*cols, "_chunk", F.lit(False).alias("_halo"))
    if halo or ahead:
        sizes = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_cn"))
        w = (Window.partitionBy(*keys) if keys else Window).orderBy("_chunk")  # one row per chunk
        ends = sizes.select(*keys, "_chunk", F.sum("_cn").over(w).alias("_end"))
        # chunks that follow, with the rows between this chunk's end and their start
        starts = ends.select(*keys, "_chunk", "_end", F.coalesce(F.lag("_end").over(w), F.lit(0)).alias("_before"))
    if halo:
        later = starts.select(*keys, "_chunk", "_end", F.collect_list(
            F.struct(F.col("_chunk").alias("to"), F.col("_before").alias("before"))).over(w.rowsBetween(1, halo)).alias("_later"))
        tails = tagged.select("*", F.row_number().over(_desc_window(chunk_spec)).alias("_rdesc")).filter(F.col("_rdesc") <= halo)
        moved = tails.join(later, [*keys, "_chunk"]).select(*cols, "_rdesc", F.explode("_later").alias("_to"), "_end")
        copies = moved.filter(F.col("_rdesc") + F.col("_to.before") - F.col("_end") <= halo).select(
            *cols, F.col("_to.to").alias("_chunk"), F.lit(True).alias("_halo"))
        own = own.unionByName(copies)
    if ahead:
        earlier = starts.select(*keys, "_chunk", "_before", F.collect_list(
            F.struct(F.col("_chunk").alias("to"), F.col("_end").alias("end"))).over(w.rowsBetween(-ahead, -1)).alias("_earlier"))
        heads = tagged.select("*", F.row_number().over(chunk_spec.window()).alias("_rasc")).filter(F.col("_rasc") <= ahead)
        moved = heads.join(earlier, [*keys, "_chunk"]).select(*cols, "_rasc", F.explode("_earlier").alias("_to"), "_before")
        copies = moved.filter(F.col("_rasc") + F.col("_before") - F.col("_to.end") <= ahead).select(
            *cols, F.col("_to.to").alias("_chunk"), F.lit(True).alias("_halo"))
        own = own.unionByName(copies)
    out = own.select("*", *build(chunk_spec))
    return out.filter(~F.col("_halo")).drop("_halo")


def chunked_window(df: DataFrame, spec: SeriesSpec, halo: int, build, n_chunks: int, ahead: int = 0) -> DataFrame:
    """Window expressions over big (or global) series in parallel chunks.

    ``halo`` must be at least the largest look-back (``max(lag, window - 1)``), ``ahead`` the largest
    look-ahead, and ``build(spec)`` returns the window expressions to add. Equal to the unchunked window.
    """
    return windowed_chunks(chunk_tags(df, spec, n_chunks, max(halo, ahead)), spec, halo, build, ahead).drop("_chunk")


def chunked_row_number(tagged: DataFrame, spec: SeriesSpec, name: str = "sample") -> DataFrame:
    """Exact 1..n row numbers per series computed chunk by chunk: chunk sizes (a small
    table) give each chunk's offset, and a row number inside the chunk finishes it."""
    keys = list(spec.keys)
    sizes = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_cn"))
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("_chunk")
    offs = sizes.select(*keys, "_chunk",
                        F.coalesce(F.sum("_cn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # at most series x chunks rows; adaptive execution broadcasts it at run time when small
    j = tagged.join(offs, [*keys, "_chunk"])
    rn = F.row_number().over(spec.with_extra("_chunk").window())
    return j.select(*tagged.columns, (F.col("_off") + rn).cast("int").alias(name))


def _desc_window(spec: SeriesSpec):
    w = Window.partitionBy(*spec.partition) if spec.partition else Window
    return w.orderBy(*[F.col(c).desc() for c in spec.order])
