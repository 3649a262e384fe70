"""Bound queries: dataset validation (V1, V2, W8) with lineitem status groups as source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.operators import validate as va
from procsig.plans.registry import register
from procsig.sources.tables import LINEITEM, table

LV = list(LINEITEM.variables)
_COLS = ["l_linestatus", "l_orderkey", "l_linenumber", "l_suppkey", *LV]


def _frame(spark, sf):
    return table(spark, sf, "lineitem").select(*_COLS)


_ORDER = """SELECT l_linestatus, CAST(count(*) FILTER (WHERE dec) AS BIGINT) AS n_decreases FROM (
  SELECT l_linestatus, coalesce(lag(l_linenumber) OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber)
                                > l_linenumber, false) AS dec FROM lineitem) GROUP BY l_linestatus"""


@register("monotonic_check", f"""
SELECT l_linestatus, n_decreases = 0 AS is_monotonic, n_decreases FROM ({_ORDER})""")
def monotonic_check(spark, sf):
    return va.order_breaks(_frame(spark, sf), "l_linestatus", ["l_orderkey", "l_linenumber"], "l_linenumber", chunks="auto")


@register("validate_dataset", f"""
WITH s AS (SELECT l_linestatus, count(*) AS n_rows,
                  CAST(count(*) FILTER (WHERE l_suppkey IS NULL OR l_linenumber IS NULL) AS BIGINT) AS n_null_keys,
                  count(DISTINCT l_suppkey) AS n_runs, min(l_linenumber) AS sample_min, max(l_linenumber) AS sample_max
           FROM lineitem GROUP BY l_linestatus),
o AS ({_ORDER}),
r AS (SELECT s.*, o.n_decreases,
             CASE WHEN n_rows < 3 THEN 'Need at least 3 rows, got ' || n_rows::VARCHAR
                  WHEN n_null_keys > 0 THEN 'NULL values in key columns: ' || n_null_keys::VARCHAR || ' rows' ELSE '' END AS errors,
             CASE WHEN n_rows < 3 THEN '' ELSE concat_ws(' | ',
                  CASE WHEN n_decreases > 0 THEN 'Samples are not in ascending order' END,
                  CASE WHEN n_runs > 1 THEN 'Multiple runs found: ' || n_runs::VARCHAR END) END AS warnings
      FROM s LEFT JOIN o ON s.l_linestatus = o.l_linestatus)
SELECT l_linestatus, n_rows, {len(_COLS)} AS n_cols, CAST(n_runs AS BIGINT) AS n_runs, sample_min, sample_max,
       errors, warnings, errors = '' AS is_valid FROM r""")
def validate_dataset(spark, sf):
    v = va.validate(_frame(spark, sf), "l_linestatus", "l_suppkey", "l_linenumber", LV, ["l_orderkey", "l_linenumber"], chunks="auto")
    return v.select("l_linestatus", "n_rows", "n_cols", "n_runs", "sample_min", "sample_max",
                    F.array_join("errors", " | ").alias("errors"), F.array_join("warnings", " | ").alias("warnings"),
                    "is_valid")
