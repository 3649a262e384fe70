"""Series specification shared by every windowed operator.

A series is the set of rows sharing ``keys``; ``order`` is the explicit order inside the
series. The reference relies on physical file order; Spark has none, so an order key is
mandatory here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    # extra partition columns used internally (e.g. a chunk id for hot series)
    extra_keys: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.order:
            raise ValueError("SeriesSpec.order must name at least one column")
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "order", tuple(self.order))
        object.__setattr__(self, "extra_keys", tuple(self.extra_keys))

    @property
    def partition(self) -> tuple[str, ...]:
        return self.keys + self.extra_keys

    def window(self) -> WindowSpec:
        w = Window.partitionBy(*self.partition) if self.partition else Window
        return w.orderBy(*[F.col(c) for c in self.order])

    def frame(self, start: int, end: int = 0) -> WindowSpec:
        return self.window().rowsBetween(start, end)

    def key_columns(self) -> list[Column]:
        return [F.col(k) for k in self.keys]

    def with_extra(self, *cols: str) -> "SeriesSpec":
        return SeriesSpec(self.keys, self.order, self.extra_keys + tuple(cols))

    def drop_null_keys(self, df: DataFrame) -> DataFrame:
        """Rows whose series key is NULL belong to no series (pandas groupby drops them)."""
        if not self.keys:
            return df
        cond = None
        for k in self.keys:
            c = F.col(k).isNotNull()
            cond = c if cond is None else cond & c
        return df.filter(cond)

    def numeric_columns(self, df: DataFrame) -> list[str]:
        """All numeric columns except the key and order columns (``columns=None``)."""
        skip = set(self.keys) | set(self.order) | set(self.extra_keys)
        numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
        return [n for n, t in df.dtypes if n not in skip and (t in numeric or t.startswith("decimal"))]
