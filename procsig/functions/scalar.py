"""Scalar column expressions (F1-F18). All JVM-side, codegen-friendly, ANSI-safe."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five section labels a structured explanation must contain, in order.
REQUIRED_FIELDS = ("STATUS:", "ISSUE:", "ROOT CAUSE:", "IMMEDIATE ACTION:", "MONITORING:")

# Alert tier boundaries on the anomaly probability.
ALERT_AT = 0.75
CAUTION_AT = 0.5

ZERO_STD_GUARD = 1e-6


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(x: str | Column) -> Column:
    """A double without NaN: NaN becomes NULL, so that aggregates skip it as pandas does."""
    x = col_(x).cast("double")
    return F.when(~F.isnan(x), x)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 (ANSI mode would throw)."""
    return F.try_divide(col_(num), col_(den))


def logistic(x: str | Column) -> Column:
    """1 / (1 + exp(-x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(x)))


def safe_sqrt(x: str | Column) -> Column:
    """sqrt, NULL for negative input."""
    x = col_(x)
    return F.when(x >= 0, F.sqrt(x))


def safe_ln(x: str | Column) -> Column:
    """natural log, NULL for non-positive input."""
    x = col_(x)
    return F.when(x > 0, F.log(x))


def normal_pdf(x: str | Column, mu: str | Column, sigma: str | Column) -> Column:
    """Gaussian density."""
    x, mu, sigma = col_(x), col_(mu), col_(sigma)
    return F.exp(-F.pow((x - mu) / sigma, 2) / 2) / (sigma * F.lit((2 * 3.141592653589793) ** 0.5))


def round_half_even(x: str | Column, digits: int) -> Column:
    """F8: round half to even in plain double arithmetic: rint(x * 10^d) / 10^d.

    NaN and infinities stay as they are and no value is too large (``round`` in Spark rounds the
    printed decimal, and a cast to BIGINT would saturate).
    """
    scale = F.lit(10.0 ** digits)
    return F.rint(col_(x).cast("double") * scale) / scale


def tenths_half_even(v: Column) -> Column:
    """round(v * 10) half-to-even on the exact binary value of v (as Python formats floats).

    20 v = 16 v + 4 v with both products exact; an error-free sum (TwoSum) gives the rounded
    sum s and its exact error e, so floor(20 v) and "20 v is an integer" are known exactly:
    an odd integer 20 v is a true tie, broken to the even tenth.
    """
    a, b = v * F.lit(16.0), v * F.lit(4.0)
    s = a + b
    bb = s - a
    err = (a - (s - bb)) + (b - bb)
    fs = F.floor(s)
    g = fs - F.when((s == fs) & (err < 0), 1).otherwise(0)        # floor(20 v), exact
    exact_int = (s == fs) & (err == 0)
    k = F.floor(g / 2)
    odd = F.pmod(g, F.lit(2)) == 1
    tie_pick = F.when(F.pmod(k, F.lit(2)) == 0, k).otherwise(k + 1)
    return F.when(~odd, k).when(exact_int, tie_pick).otherwise(k + 1)


def with_count_below(df, sorted_arr: Column, x: Column, max_len: int, name: str, inclusive: bool = False):
    """Add ``name`` = number of elements of an ascending array that are < x (<= x with
    ``inclusive``): a binary search of ceil(log2(max_len)) probes with ``try_element_at``.

    Each probe is its own projection (the column is referenced more than once, so Catalyst
    keeps the steps apart): plain comparisons inside generated code, expression size linear
    in the number of probes — unlike a ``filter`` lambda, interpreted element by element.
    """
    steps = []
    s = 1
    while s <= max(max_len, 1):
        steps.append(s)
        s *= 2
    out = df.select("*", F.lit(0).alias(name))
    for step in reversed(steps):
        idx = F.col(name) + F.lit(step)
        probe = F.try_element_at(sorted_arr, idx)
        hit = (probe <= x) if inclusive else (probe < x)
        out = out.withColumn(name, F.when(hit, idx).otherwise(F.col(name)))
    return out


def percent_text(x: str | Column) -> Column:
    """Python's ``f'{x:.1%}'``: x * 100 in double, then half-to-even on its binary value,
    so 0.1225 -> ``12.2%``; printed with integer arithmetic."""
    n = tenths_half_even(col_(x) * F.lit(100.0))
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    m = F.abs(n)
    return F.concat(sign, F.floor(m / 10).cast("string"), F.lit("."), F.pmod(m, F.lit(10)).cast("string"), F.lit("%"))


def percent_text_sql(x: str) -> str:
    """DuckDB twin of ``percent_text`` (same IEEE operations)."""
    v = f"(({x}) * 100.0)"
    a, b = f"({v} * 16.0)", f"({v} * 4.0)"
    s = f"({a} + {b})"
    bb = f"({s} - {a})"
    err = f"(({a} - ({s} - {bb})) + ({b} - {bb}))"
    fs = f"floor({s})"
    g = f"(CAST({fs} AS BIGINT) - CASE WHEN {s} = {fs} AND {err} < 0 THEN 1 ELSE 0 END)"
    k = f"(({g}) // 2)"
    n = (f"(CASE WHEN ({g}) % 2 = 0 THEN {k} WHEN {s} = {fs} AND {err} = 0 "
         f"THEN (CASE WHEN {k} % 2 = 0 THEN {k} ELSE {k} + 1 END) ELSE {k} + 1 END)")
    return f"((abs({n}) // 10)::VARCHAR || '.' || (abs({n}) % 10)::VARCHAR || '%')"


def base_of(feature: str | Column, parts: int = 2) -> Column:
    """first ``parts`` underscore-separated parts of a feature name (name-parsing fallback)."""
    return F.substring_index(col_(feature), "_", parts)


def tier(conf: str | Column) -> Column:
    """F16: ALERT / CAUTION / NORMAL by confidence."""
    c = col_(conf)
    return F.when(c >= ALERT_AT, "ALERT").when(c >= CAUTION_AT, "CAUTION").otherwise("NORMAL")


def contains_all(text: str | Column, fields: Iterable[str] = REQUIRED_FIELDS) -> Column:
    """text contains every required field label."""
    t = col_(text)
    return F.coalesce(reduce(lambda a, b: a & b, [t.contains(f) for f in fields]), F.lit(False))


def action_line(text: str | Column, default: str = "Monitor process parameters") -> Column:
    """text after the first ``IMMEDIATE ACTION:`` line label, else a default."""
    got = F.regexp_extract(col_(text), r"(?m)^IMMEDIATE ACTION:(.*)$", 1)
    return F.coalesce(F.nullif(F.trim(got), F.lit("")), F.lit(default))


def cache_key(conf: str | Column, descriptions: str | Column) -> Column:
    """md5 of ``"{round(conf,2)}_{sorted descriptions as a list literal}"``."""
    listed = F.concat(F.lit("['"), F.array_join(F.array_sort(col_(descriptions)), "', '"), F.lit("']"))
    listed = F.when(F.size(col_(descriptions)) == 0, F.lit("[]")).otherwise(listed)
    return F.md5(F.concat_ws("_", round_half_even(col_(conf), 2).cast("string"), listed))


def cache_key_sql(conf: str, descriptions: str) -> str:
    """DuckDB twin of ``cache_key``: ``descriptions`` is a list expression."""
    listed = (f"CASE WHEN len({descriptions}) = 0 THEN '[]' "
              f"ELSE '[''' || array_to_string(list_sort({descriptions}), ''', ''') || ''']' END")
    return f"md5(CAST(round_even(({conf}) * 100.0, 0) / 100.0 AS VARCHAR) || '_' || {listed})"


def clock_text(ts: str | Column) -> Column:
    """time of day HH:mm."""
    return F.date_format(col_(ts), "HH:mm")


def has_suffix(name: str | Column, suffix: str = ".csv") -> Column:
    """case-insensitive suffix test."""
    return F.lower(col_(name)).endswith(suffix.lower())
