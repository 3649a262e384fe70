"""Dataset profile (A1-A9): one aggregation per report, transposed with ``stack``/``inline``.

Each report is a single pass with map-side partial aggregation. ``describe`` quartiles are
exact by default (Spark ``percentile``: linear interpolation, memory grows with the number
of distinct values per column); ``exact=False`` switches to ``percentile_approx`` whose
memory is fixed, for very large inputs.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsig.functions.scalar import clean, round_half_even


def _numeric(df: DataFrame) -> list[str]:
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return [c for c, t in df.dtypes if t in numeric or t.startswith("decimal")]


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
             accuracy: int = 10_000) -> DataFrame:
    """A1: count, mean, std (ddof 1), min, 25/50/75 %, max per column, one row per column.

    Moments come from one aggregate; quartiles are exact by default via bucketed order
    statistics (``stats.exact_quantiles``: memory bounded whatever the number of distinct
    values), or ``percentile_approx`` with ``exact=False``.
    """
    from procsig.operators.stats import exact_quantiles, unpivot
    cols = list(columns) if columns is not None else _numeric(df)
    aggs = []
    for i, c in enumerate(cols):
        x = clean(c)
        extra = []
        if not exact:
            q = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy)
            extra = [q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75")]
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *extra).alias(f"_s{i}"))
    mom = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(cols))])))
    if exact:
        qs = exact_quantiles(unpivot(df, [], cols, name="column_name"), ["column_name"], "value",
                             [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
        mom = mom.join(qs, "column_name", "left")  # both sides: one row per column
    return mom.select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None, total_name: str = "__total__") -> DataFrame:
    """A2: NULL (and NaN) count per column plus a grand-total row."""
    cols = list(columns) if columns is not None else df.columns
    types = dict(df.dtypes)

    def miss(c):
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return F.sum(m.cast("long"))

    row = df.agg(*[miss(c).alias(f"_m{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"_m{i}"), F.lit(0)).cast("long").alias("n_missing"))
             for i, c in enumerate(cols)]
    total = F.lit(0).cast("long")
    for i in range(len(cols)):
        total = total + F.coalesce(F.col(f"_m{i}"), F.lit(0))
    items.append(F.struct(F.lit(total_name).alias("column_name"), total.cast("long").alias("n_missing")))
    return row.select(F.inline(F.array(*items)))


def duplicate_stats(df: DataFrame, digits: int = 3) -> DataFrame:
    """A3: rows, duplicate rows (after the first copy) and their percentage.

    ``groupBy(all columns).count()`` combines copies map-side before the shuffle, so a row
    repeated a billion times costs one partial count per task.
    """
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    agg = g.agg(F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return agg.select(
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
        (F.coalesce(F.col("n_rows"), F.lit(0)) - F.col("n_distinct")).cast("long").alias("n_duplicates"),
        F.coalesce(round_half_even(F.try_divide((F.col("n_rows") - F.col("n_distinct")) * 100.0, F.col("n_rows")), digits),
                   F.lit(0.0)).alias("duplicate_pct"))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """A4: keep one copy of each row (always when asked)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """A5: distinct non-NULL values per column (NaN excluded, like pandas ``nunique``).

    Exact form runs one ``count(DISTINCT)`` per column in a single aggregate (Spark
    expands it to one shuffle); ``approx=True`` uses HyperLogLog++ with fixed memory.
    """
    cols = list(columns) if columns is not None else df.columns
    types = dict(df.dtypes)

    def val(c):
        x = F.col(c)
        return F.when(~F.isnan(x), x) if types[c] in ("double", "float") else x

    fn = (lambda x: F.approx_count_distinct(x, rsd)) if approx else F.count_distinct
    row = df.agg(*[fn(val(c)).alias(f"_d{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"_d{i}").cast("long").alias("n_distinct"))
             for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*items)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column."""
    return df.select(column).distinct()


def shape_summary(df: DataFrame) -> DataFrame:
    """Per column its type, non-NULL count, plus the frame's rows and columns."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                      F.col(f"_c{i}").cast("long").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)]
    return row.select(F.inline(F.array(*items)), F.col("_n").cast("long").alias("n_rows"),
                      F.lit(len(cols)).alias("n_cols"))


def value_range(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Min and max of a column (per group)."""
    g = df.groupBy(*group) if group else df.groupBy()
    return g.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def table_sizes(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table (each count reads only Parquet metadata or one column)."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
