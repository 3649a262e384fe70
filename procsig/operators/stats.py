"""Exploratory statistics.

Every report is built from grouped aggregations whose output is small (pairs, bins,
categories); the raw rows are scanned once per report with map-side partial aggregation.
Only fixed-size results (two-number ranges, at most ``bins`` histogram cells) ever reach
the driver, and only to become literals of the next expression.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from procsig.functions.scalar import clean, normal_pdf, safe_ln, safe_sqrt, with_count_below
from procsig.plans.guard import bounded_broadcast, collect_bounded
from procsig.session import cut_lineage


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    """Wide -> long: one (keep..., variable, value) row per column, NaN as NULL (a generator, no shuffle)."""
    items = [F.struct(F.lit(c).alias(name), clean(c).alias(value)) for c in columns]
    return df.select(*keep, F.inline(F.array(*items)))


# ----------------------------------------------------------------- A10 correlation

def _gram_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str], shift: Sequence[float]) -> DataFrame:
    """``by..., i, v``: for variable i, the sums over the rows where it and each other variable are present:
    count, x_i, x_j, x_i^2, x_j^2 and x_i x_j (each a block of ``len(columns)`` numbers), less the shifts."""
    d, centre = len(columns), np.array(shift)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in it:
            x = np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1) - centre
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            keys = list(zip(*[b.column(f"k{i}").to_pylist() for i in range(len(by))])) if by else [()] * b.num_rows
            code: dict[tuple, int] = {}
            of = np.array([code.setdefault(k, len(code)) for k in keys])
            for k, c in code.items():
                mk, xk = (m, x) if len(code) == 1 else (m[of == c], x[of == c])
                one, two = xk.T @ mk, (xk * xk).T @ mk
                part = np.concatenate([mk.T @ mk, one, one.T, two, two.T, xk.T @ xk], axis=1)
                total[k] = total[k] + part if k in total else part
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * d, type=kinds[i]) for i, v in enumerate(k)), pa.array(range(d), pa.int32()),
                                              pa.array(list(t), pa.list_(pa.float64()))], names=[*(f"k{i}" for i in range(len(by))), "i", "v"])
    given = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    kinds = [to_arrow_type(given.schema[f"k{i}"].dataType) for i in range(len(by))]
    schema = ", ".join([*(f"k{i} {given.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(by))), "i int", "v array<double>"])
    keys = [f"k{i}" for i in range(len(by))]
    return given.mapInArrow(sums, schema).groupBy(*keys, "i").agg(Summarizer.sum(array_to_vector("v")).alias("s"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), absolute: bool = False) -> DataFrame:
    """A10: Pearson r for every pair a <= b over rows where both are present (neither NULL nor NaN).

    One blocked Gram aggregate, whatever the number of columns: every task multiplies its rows (with masks for
    missing values) into one matrix of sums per group, Spark adds the matrices up by variable. Values are
    taken relative to a typical value of their column (its approximate median, a value of the data),
    so that large offsets do not cancel. NULL where a spread is zero.
    """
    columns, by = list(columns), list(by)
    middle = df.agg(*[F.percentile_approx(clean(c), 0.5, 100).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = [float(v) if v is not None and math.isfinite(v) else 0.0 for v in middle]
    sums = _gram_sums(df, columns, by, shift)
    d = len(columns)
    part = lambda k: F.get(F.col("v"), F.lit(k * d) + F.col("j"))
    cells = sums.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], "i", vector_to_array("s").alias("v"),
                        F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("j")).where("i <= j")
    n, tiny = part(0), F.lit(1e-13)  # a spread below this share of the second moment is rounding
    cells = cells.select(*by, "i", "j", n.alias("n"), (part(5) * n - part(1) * part(2)).alias("c"),
                         (part(3) * n - part(1) * part(1)).alias("a"), (part(4) * n - part(2) * part(2)).alias("b"),
                         (part(3) * n * tiny).alias("ta"), (part(4) * n * tiny).alias("tb"))
    spread = F.when((F.col("a") > F.col("ta")) & (F.col("b") > F.col("tb")), F.sqrt("a") * F.sqrt("b"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("c"), spread)))
    r = F.when(spread.isNotNull(), r)
    names = F.array(*[F.lit(c) for c in columns])
    return cells.select(*by, F.get(names, F.col("i")).alias("var_a"), F.get(names, F.col("j")).alias("var_b"), (F.abs(r) if absolute else r).alias("corr"))


# ----------------------------------------------------------------- A11-A13 variability

def variability(df: DataFrame, columns: Sequence[str], category: str) -> DataFrame:
    """Per (variable, category) sample std, mean, range and cv = std/mean (0 when mean = 0).

    One unpivot and one grouped aggregation instead of one scan per variable and category.
    """
    long = unpivot(df, [category], columns)
    g = long.groupBy("variable", F.col(category).alias("category")).agg(
        F.stddev_samp("value").alias("std"), F.avg("value").alias("mean"),
        (F.max("value") - F.min("value")).alias("range"))
    return g.select("*", F.when(F.col("mean") == 0, F.lit(0.0))
                    .otherwise(F.try_divide(F.col("std"), F.col("mean"))).alias("cv"))


def pivot_wide(long: DataFrame, row: str, column: str, value: str, values: Sequence[str] | None = None) -> DataFrame:
    """Long -> wide with one column per category (give ``values`` to skip the extra pass)."""
    g = long.groupBy(row)
    p = g.pivot(column, list(values)) if values is not None else g.pivot(column)
    return p.agg(F.first(value))


def normalise_by_max(long: DataFrame, value: str, within: str, name: str | None = None) -> DataFrame:
    """Value / max(value) within each ``within`` group (NULL when that max is 0)."""
    w = Window.partitionBy(within)
    return long.select("*", F.try_divide(F.col(value), F.max(value).over(w)).alias(name or f"{value}_norm"))


# ----------------------------------------------------------------- exact quantiles at scale

def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, buckets: int = 64, accuracy: int = 1_000,
                    sample_every: int = 16, max_in_memory_distinct: int | None = 2_000_000,
                    max_groups_broadcast: int = 100_000) -> DataFrame:
    """Exact linear-interpolation quantiles (same definition as Spark ``percentile`` and
    DuckDB ``quantile_cont``) per group, without holding a group's values in memory.

    1. per group: count and ``buckets - 1`` approximate boundaries (fixed-size sketch);
    2. per (group, bucket): row count, and each bucket's rank offset (tiny table);
    3. only buckets that contain one of the target ranks floor/ceil(p (n - 1)) are kept and
       ranked inside themselves (each holds about n / buckets rows);
    4. the rows at the target ranks (at most 2 per quantile) are interpolated.

    The per-group boundaries are materialised and broadcast up to ``max_groups_broadcast``
    groups; beyond that they are joined by a shuffle. The boundaries only balance the buckets, so a coarse sketch (``accuracy``) suffices.

    Strategy by checked size: one HyperLogLog pass measures the largest number of distinct
    values in any group; at or below ``max_in_memory_distinct`` Spark's exact ``percentile``
    (a per-group value -> count map, memory proportional to distinct values) is safe and
    faster, above it the bucketed selection runs. ``None`` always uses the bucketed path.
    """
    names = list(names) if names is not None else [f"q{i}" for i in range(len(probs))]
    keys = list(keys)
    if not keys:
        raise ValueError("exact_quantiles needs at least one grouping key")
    x = F.col(value).cast("double")
    data = long.filter(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"))
    if max_in_memory_distinct is not None:
        widest = data.groupBy(*keys).agg(F.approx_count_distinct("_x", 0.05).alias("_d")).agg(F.max("_d")).first()[0]
        if widest is None or widest <= max_in_memory_distinct:
            q = F.percentile("_x", F.array(*[F.lit(float(p)) for p in probs]))
            return data.groupBy(*keys).agg(q.alias("_q")).select(
                *keys, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    bprobs = [i / buckets for i in range(1, buckets)]
    # the boundaries only balance the buckets (any sorted values give exact results), so the
    # sketch sees a deterministic 1-in-`sample_every` hash sample while all rows are counted
    sampled = F.when(F.pmod(F.xxhash64(F.col("_x")), F.lit(sample_every)) == 0, F.col("_x"))
    st = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                 F.array_distinct(F.percentile_approx(sampled, bprobs, accuracy)).alias("_b"))
    st = st.select(*keys, "_n", F.coalesce(F.col("_b"), F.array().cast("array<double>")).alias("_b"))
    # one row per group, broadcast under its counted size: raw rows are not gathered by group.
    # Equal values of a bucket are one row from here on, so a value that fills a third of the
    # rows costs one partial count per task.
    st = bounded_broadcast(cut_lineage(st), max_groups_broadcast)
    tagged = (with_count_below(data.join(st, keys), F.col("_b"), F.col("_x"), buckets, "_k")
              .groupBy(*keys, "_k", "_x").agg(F.count(F.lit(1)).alias("_w"), F.first("_n").alias("_n")))

    def targets(n: Column) -> Column:
        out = []
        for p in probs:
            pos = F.lit(float(p)) * (n - 1)
            out += [F.floor(pos), F.ceil(pos)]
        return F.array(*out)

    cnt = tagged.groupBy(*keys, "_k").agg(F.sum("_w").alias("_c"), F.first("_n").alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_k")  # at most `buckets` rows per group
    cnt = cnt.select("*", F.coalesce(F.sum("_c").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                     F.lit(0)).alias("_off"))
    need = cnt.filter(F.exists(targets(F.col("_n")), lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_c"))))
    sel = tagged.join(need.select(*keys, "_k", "_off"), [*keys, "_k"])
    wr = Window.partitionBy(*keys, "_k").orderBy("_x")
    ranked = sel.select(*keys, "_x", "_n", (F.col("_off") + F.sum("_w").over(wr)).alias("_end"), "_w")
    hit = ranked.select(*keys, "_x", "_n", F.explode(F.filter(
        F.array_distinct(targets(F.col("_n"))), lambda r: (r >= F.col("_end") - F.col("_w")) & (r < F.col("_end")))).alias("_r"))
    picked = hit.groupBy(*keys).agg(F.first("_n").alias("_n"),
                                    F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_m"))
    out = []
    for p, nm in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        vlo, vhi = F.col("_m")[lo], F.col("_m")[hi]
        out.append(F.when(hi == lo, vlo).otherwise((hi - pos) * vlo + (pos - lo) * vhi).alias(nm))
    return picked.select(*keys, *out)


# ----------------------------------------------------------------- A14 box statistics

def box_stats(df: DataFrame, columns: Sequence[str], category: str, exact: bool = True,
              accuracy: int = 10_000, max_groups_broadcast: int = 100_000) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers clipped to the data, outlier counts per (variable, category).

    Pass 1 computes exact quartiles per group (``exact_quantiles``: bounded memory, or
    ``percentile_approx`` with ``exact=False``), pass 2 joins them back and finds whiskers
    and outliers; adaptive execution broadcasts the per-group quartile table when small.
    """
    long = unpivot(df, [category], columns).withColumnRenamed(category, "category").filter(F.col("value").isNotNull())
    if exact:
        qs = exact_quantiles(long, ["variable", "category"], "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    else:
        q = F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy)
        qs = long.groupBy("variable", "category").agg(q.alias("_q")).select(
            "variable", "category", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    qs = qs.select("*", (F.col("q3") - F.col("q1")).alias("iqr"))
    qs = qs.select("*", (F.col("q1") - 1.5 * F.col("iqr")).alias("lower_fence"),
                   (F.col("q3") + 1.5 * F.col("iqr")).alias("upper_fence"))
    # one row per group: materialised once and broadcast under its counted size, so that the raw
    # rows are never shuffled on the category
    qs = cut_lineage(qs.withColumnsRenamed({"variable": "_v", "category": "_c"}))
    j = long.join(bounded_broadcast(qs, max_groups_broadcast),
                  (F.col("variable") == F.col("_v")) & F.col("category").eqNullSafe(F.col("_c")))
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    return j.groupBy("variable", "category", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).cast("long").alias("n"))


# ----------------------------------------------------------------- A15 histogram

def value_bounds(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    r = collect_bounded(df.agg(F.min(clean(column)).alias("lo"), F.max(clean(column)).alias("hi")), 1)[0]
    return r["lo"], r["hi"]


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin over [lo, hi]; the maximum falls in the last bin; one bin if hi == lo."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("int"), F.lit(bins - 1))


def histogram(df: DataFrame, column: str, bins: int = 25, hue: str | None = None, stat: str = "probability",
              bounds: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width histogram over the global range (shared across hue), stat one of
    count / probability / percent / density / frequency, normalised over all rows."""
    lo, hi = bounds if bounds is not None else value_bounds(df, column)
    x = clean(column)
    keep = df.filter(x.isNotNull() & x.between(lo, hi)) if lo is not None else df.limit(0)
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    width = (hi - lo) / bins if hi != lo else 1.0
    n_bins = bins if hi != lo else 1
    grp = ["category"] if hue else []
    hit = keep.select(*([F.col(hue).alias("category")] if hue else []), bin_index(x, lo, hi, bins).alias("bin"))
    counts = hit.groupBy(*grp, "bin").agg(F.count(F.lit(1)).alias("count"))
    # Every bin is a row, empty ones with count 0; the table has bins x categories rows.
    every = F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")
    slots = (counts.select("category").distinct().select("category", every) if hue
             else df.sparkSession.range(1).select(every))
    slots = slots.select(*[F.col(g).alias(f"_{g}") for g in grp], F.col("bin").alias("_bin"))
    same = F.col("bin") == F.col("_bin")
    for g in grp:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    counts = slots.join(counts, same, "left").select(*[F.col(f"_{g}").alias(g) for g in grp], F.col("_bin").alias("bin"),
                                                     F.coalesce("count", F.lit(0)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # bins x hue rows: bounded
    share = F.try_divide(F.col("count"), total)
    val = {"count": F.col("count").cast("double"), "probability": share, "percent": share * 100.0,
           "density": share / F.lit(width), "frequency": F.col("count") / F.lit(width)}[stat]
    return counts.select(*grp, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_left"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_right"),
                         F.col("count").cast("long").alias("count"), val.alias(stat))


# ----------------------------------------------------------------- A16-A18 distributions

def normal_fit(df: DataFrame, column: str, points: int = 500) -> DataFrame:
    """Maximum-likelihood mu, sigma (ddof 0) and the normal pdf on ``points`` grid points
    spanning [min, max]. The grid is generated from the one-row stats (no join)."""
    x = clean(column)
    st = df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    g = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    gx = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    g = g.select("i", "mu", "sigma", gx.alias("x"))
    return g.select("i", "x", "mu", "sigma", normal_pdf("x", "mu", F.nullif("sigma", F.lit(0.0))).alias("pdf"))


def kde_curve(df: DataFrame, column: str, points: int = 200, fine_bins: int = 512) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (std_samp * n^(-1/5)) on binned data.

    The values are first counted into ``fine_bins`` equal-width cells (one aggregation),
    the cells are collected into one bounded array, and each grid point sums over that array
    with a higher-order function: cost independent of the row count, no join.
    """
    x = F.col(column).cast("double")
    keep = df.filter(x.isNotNull() & ~F.isnan(x))
    lo, hi = value_bounds(keep, column)
    width = (hi - lo) / fine_bins if hi != lo else 1.0
    cells = keep.groupBy(bin_index(x, lo, hi, fine_bins).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    st = collect_bounded(keep.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd")), 1)[0]
    n, h = st["n"], (st["sd"] or 0.0) * st["n"] ** -0.2 if st["n"] else 0.0
    packed = cells.agg(F.collect_list(F.struct(
        (F.lit(lo) + (F.col("b") + F.lit(0.5)) * F.lit(width)).alias("c"), F.col("w").cast("double").alias("w"))).alias("cells"))
    one = packed.select("cells", F.lit(float(n)).alias("n"), F.lit(float(h)).alias("h"))
    grid = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.select("*", (F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))).alias("x"))
    dens = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["w"] * F.exp(
        -F.pow((F.col("x") - c["c"]) / F.col("h"), 2) / 2))
    return grid.select("i", "x", (dens / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def transform_moments(df: DataFrame, column: str) -> DataFrame:
    """N, mean, population std of the raw, sqrt and log transforms (NULL outside domain)."""
    x = clean(column)
    forms = {"raw": x, "sqrt": safe_sqrt(x), "log": safe_ln(x)}
    aggs = [F.struct(F.lit(k).alias("transform"), F.count(v).cast("long").alias("n"), F.avg(v).alias("mean"),
                     F.stddev_pop(v).alias("std")).alias(f"_t{i}") for i, (k, v) in enumerate(forms.items())]
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_t{i}") for i in range(len(forms))])))


# ----------------------------------------------------------------- A19-A20 mutual information

def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between each binned feature and a discrete target.

    Equal-width bins per feature over its own range (one aggregate for all ranges), then one
    grouped count of (feature, bin, target) cells; marginals come from windows over that
    small cell table.
    """
    rng = collect_bounded(df.agg(*[F.struct(F.min(clean(c)).alias("lo"), F.max(clean(c)).alias("hi")).alias(f"_r{i}")
                                   for i, c in enumerate(columns)]), 1)[0]
    items = []
    for i, c in enumerate(columns):
        lo, hi = rng[f"_r{i}"]["lo"], rng[f"_r{i}"]["hi"]
        x = clean(c)
        b = bin_index(x, lo, hi, bins) if lo is not None else F.lit(None).cast("int")
        items.append(F.struct(F.lit(c).alias("feature"), F.when(x.isNotNull(), b).alias("bin")))
    long = df.select(F.col(target).alias("_y"), F.inline(F.array(*items))).filter(
        F.col("bin").isNotNull() & F.col("_y").isNotNull())
    cells = long.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).cast("double").alias("n_xy"))
    wf = Window.partitionBy("feature")
    cells = cells.select("*", F.sum("n_xy").over(wf).alias("n"),
                         F.sum("n_xy").over(Window.partitionBy("feature", "bin")).alias("n_x"),
                         F.sum("n_xy").over(Window.partitionBy("feature", "_y")).alias("n_y"))
    term = (F.col("n_xy") / F.col("n")) * F.log(F.col("n_xy") * F.col("n") / (F.col("n_x") * F.col("n_y")))
    return cells.groupBy("feature").agg(F.sum(term).alias("mi"))


def top_k(df: DataFrame, score: str, k: int, name: str = "feature") -> DataFrame:
    """Rank by score descending (ties by name) and keep the best k."""
    w = Window.orderBy(F.col(score).desc(), F.col(name))  # input is one row per feature: bounded
    return df.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


# ----------------------------------------------------------------- W11-W12 series views

def anomaly_period(df: DataFrame, series: Sequence[str], sample: str, label: str,
                   prediction: str | None = None) -> DataFrame:
    """Per series with any labelled row: first labelled sample to the last sample."""
    aggs = [F.min(F.when(F.col(label), F.col(sample))).alias("period_start"), F.max(sample).alias("period_end")]
    if prediction:
        aggs.append(F.count_if(F.col(prediction) == 1).cast("long").alias("n_predicted"))
    return df.groupBy(*series).agg(*aggs).filter(F.col("period_start").isNotNull())


def series_compare(df: DataFrame, columns: Sequence[str], category: str, series: str, x: str,
                   marker: int) -> DataFrame:
    """Mean value per (variable, category, series, x) — repeated x averaged — and an
    ``after_marker`` flag for x beyond the event marker. All variables are averaged in one group per
    (category, series, x); the groups, not the rows, become one row per variable."""
    g = df.groupBy(F.col(category).alias("category"), series, x).agg(*[F.avg(clean(c)).alias(f"_v{i}") for i, c in enumerate(columns)])
    items = [F.struct(F.lit(c).alias("variable"), F.col(f"_v{i}").alias("value")) for i, c in enumerate(columns)]
    long = g.select("category", series, x, F.inline(F.array(*items)))
    return long.select("variable", "category", series, x, "value", (F.col(x) > F.lit(marker)).alias("after_marker"))
