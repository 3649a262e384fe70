"""Registry of the bound queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.functions.scalar import round_half_even

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = tie_safe_round_sql(sql)
        return fn
    return deco


def tie_safe_round_sql(sql: str) -> str:
    """For display only: write every ``round(expr, d)`` as ``round_even(expr * 1e{d}, 0) / 1e{d}``.

    DuckDB's own half-to-even rounding; its ``round`` breaks ties away from zero, against the rule
    of F8 (half to even).
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + 6:k - 1]
        if comma < 0:
            expr, d = inner, "0"
        else:
            expr, d = sql[j + 6:comma], sql[comma + 1:k - 1].strip()
        expr = tie_safe_round_sql(expr)
        out.append(sql[i:j])
        out.append(f"(round_even(CAST(({expr}) AS DOUBLE) * 1e{d}, 0) / 1e{d})")
        i = k


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Round every double column (float noise would break value hashes)."""
    out = []
    for c, t in df.dtypes:
        d = digits.get(c, digits.get("*", 6)) if isinstance(digits, dict) else digits
        out.append(round_half_even(F.col(c), d).alias(c) if t in ("double", "float") else F.col(c))
    return df.select(*out)


def load_all() -> None:
    """Import every query module so that its queries register."""
    from procsig.plans import (queries_features, queries_profile, queries_stats,  # noqa: F401
                               queries_detect, queries_evaluate, queries_report, queries_validate,
                               queries_models, queries_stream, queries_sources,
                               queries_prepare, queries_uploads)
