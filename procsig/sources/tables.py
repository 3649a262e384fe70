"""Table loading and the bindings of the driver's tables to the process-data roles.

The driver's tables hold no process data, so each operator is bound to a table that has the
same shape: ``lineitem`` is a multivariate multi-series table (series = supplier, four
numeric variables, label = returned), ``events`` a univariate one (series = user).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.spec import SeriesSpec

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class Binding:
    table: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    variables: tuple[str, ...]
    label_sql: str
    category: str | None = None

    @property
    def spec(self) -> SeriesSpec:
        return SeriesSpec(self.keys, self.order)

    @property
    def label(self) -> Column:
        return F.expr(self.label_sql)

    def load(self, spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
        """Only the columns the role needs (pruned at the Parquet scan) plus ``label``."""
        cols = list(dict.fromkeys(self.keys + self.order + self.variables + extra
                                  + ((self.category,) if self.category else ())))
        return table(spark, sf_dir, self.table).select(*cols, self.label.alias("label"))


LINEITEM = Binding(
    table="lineitem",
    keys=("l_suppkey",),
    order=("l_shipdate", "l_orderkey", "l_linenumber"),
    variables=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    label_sql="l_returnflag = 'R'",
    category="l_linestatus",
)

EVENTS = Binding(
    table="events",
    keys=("user_id",),
    order=("ts", "event_id"),
    variables=("value",),
    label_sql="event_type = 'error'",
    category="event_type",
)

# Our own short descriptions of the bound variables (the variable dimension, J1).
VARIABLE_DESCRIPTIONS = {
    "l_quantity": "ordered quantity",
    "l_extendedprice": "extended line price",
    "l_discount": "line discount rate",
    "l_tax": "line tax rate",
    "value": "event value",
}


def variable_dim(spark: SparkSession, descriptions: dict[str, str] = VARIABLE_DESCRIPTIONS) -> DataFrame:
    return spark.createDataFrame(sorted(descriptions.items()), "base string, description string")
