"""Small generators for the DuckDB oracle SQL (same feature lists as the Spark side)."""

from __future__ import annotations

from typing import Sequence

from procsig.operators.features import ROLLING_STATS, diff_name, lag_name, rolling_name
from procsig.sources.tables import Binding

_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def win(b: Binding | None = None, keys: Sequence[str] = (), order: Sequence[str] = ()) -> str:
    keys = b.keys if b is not None else keys
    order = b.order if b is not None else order
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"{part}ORDER BY {', '.join(order)}"


def lag_sql(c: str, k: int, w: str) -> str:
    if k > 0:
        e = f"lag({c}, {k}) OVER ({w})"
    elif k < 0:
        e = f"lead({c}, {-k}) OVER ({w})"
    else:
        e = c
    return f"{e} AS {q(lag_name(c, k))}"


def rolling_sql(c: str, w_size: int, stat: str, w: str) -> str:
    return (f"{_AGG[stat]}({c}) OVER ({w} ROWS BETWEEN {w_size - 1} PRECEDING AND CURRENT ROW) "
            f"AS {q(rolling_name(c, stat, w_size))}")


def diff_sql(c: str, w: str) -> str:
    return f"{c} - lag({c}, 1) OVER ({w}) AS {q(diff_name(c))}"


def feature_sql(columns: Sequence[str], w: str, lags=(1, 2), windows=(3,), stats=ROLLING_STATS) -> list[str]:
    out = [lag_sql(c, k, w) for c in columns for k in lags]
    out += [rolling_sql(c, ws, s, w) for c in columns for ws in windows for s in stats]
    out += [diff_sql(c, w) for c in columns]
    return out


def complete(cols: Sequence[str], doubles: Sequence[str] = ()) -> str:
    """SQL form of ``na.drop('any')``: not NULL, and not NaN for floating columns."""
    parts = [f"{q(c)} IS NOT NULL" for c in cols]
    parts += [f"NOT isnan({q(c)})" for c in doubles]
    return " AND ".join(parts) if parts else "TRUE"


def rnd(cols: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f"round({q(c)}, {digits}) AS {q(c)}" for c in cols)
