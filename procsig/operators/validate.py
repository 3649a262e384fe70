"""Dataset validation (V1, V2, W8): one report row per source file.

Schema-level checks (missing or non-numeric columns) are decided from the schema once;
data-level checks (row count, NULL keys, order, number of series, sample range) are one
grouped aggregation per source plus one windowed pass for the order check.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def order_breaks(df: DataFrame, source: str, ingest_order: Sequence[str], sample: str,
                 chunks: int | str = 1) -> DataFrame:
    """Per source, how often ``sample`` decreases along the ingest order.

    ``chunks > 1`` splits big sources into ordered ranges with one halo row (same result).
    """
    from procsig.operators.features import windowed
    from procsig.spec import SeriesSpec
    spec = SeriesSpec((source,), tuple(ingest_order))

    def build(s: SeriesSpec):
        return [F.coalesce(F.lag(F.col(sample)).over(s.window()) > F.col(sample), F.lit(False)).alias("_dec")]

    marked = windowed(df.select(*dict.fromkeys([source, *ingest_order, sample])), spec, 1, build, chunks)
    return marked.groupBy(source).agg(F.count_if("_dec").cast("long").alias("n_decreases")).select(
        source, (F.col("n_decreases") == 0).alias("is_monotonic"), "n_decreases")


def _msg(prefix: str, items: Sequence[str]) -> str:
    return f"{prefix}: {', '.join(items)}"


def validate(df: DataFrame, source: str, run: str, sample: str, features: Sequence[str],
             ingest_order: Sequence[str], min_rows: int = 3, chunks: int | str = 1) -> DataFrame:
    """V1 + V2: errors, warnings, validity, shape, series count and sample range per source."""
    cols = df.columns
    types = dict(df.dtypes)
    keys = [run, sample]
    schema_errors = []
    missing_keys = [k for k in keys if k not in cols]
    if missing_keys:
        schema_errors.append(_msg("Missing key columns", missing_keys))
    missing_feats = [f for f in features if f not in cols]
    if missing_feats:
        schema_errors.append(_msg("Missing feature columns", missing_feats))
    non_numeric = [f for f in features if f in cols and types[f] not in _NUMERIC and not types[f].startswith("decimal")]
    if non_numeric:
        schema_errors.append(_msg("Non-numeric feature columns", non_numeric[:3]))
    null_keys = F.lit(False)
    for k in keys:
        if k in cols:
            null_keys = null_keys | F.col(k).isNull()
    stats = df.groupBy(source).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_if(null_keys).cast("long").alias("n_null_keys"),
        (F.count_distinct(F.col(run)) if run in cols else F.lit(0)).cast("long").alias("n_runs"),
        (F.min(sample) if sample in cols else F.lit(None)).alias("sample_min"),
        (F.max(sample) if sample in cols else F.lit(None)).alias("sample_max"))
    if sample in cols:
        order = order_breaks(df, source, ingest_order, sample, chunks).select(source, "n_decreases")
        stats = stats.join(order, source, "left")
    else:
        stats = stats.select("*", F.lit(0).cast("long").alias("n_decreases"))
    data_errors = F.array(
        *[F.lit(e) for e in schema_errors],
        F.when(F.col("n_null_keys") > 0,
               F.concat(F.lit("NULL values in key columns: "), F.col("n_null_keys").cast("string"), F.lit(" rows"))))
    too_few = F.concat(F.lit(f"Need at least {min_rows} rows, got "), F.col("n_rows").cast("string"))
    errors = F.when(F.col("n_rows") < min_rows, F.array(too_few)).otherwise(F.array_compact(data_errors))
    warnings = F.when(F.col("n_rows") < min_rows, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when(F.col("n_decreases") > 0, F.lit("Samples are not in ascending order")),
        F.when(F.col("n_runs") > 1, F.concat(F.lit("Multiple runs found: "), F.col("n_runs").cast("string"))))))
    out = stats.select(source, "n_rows", F.lit(len(cols)).alias("n_cols"), "n_runs", "sample_min", "sample_max",
                       errors.alias("errors"), warnings.alias("warnings"))
    return out.select("*", (F.size("errors") == 0).alias("is_valid"))
