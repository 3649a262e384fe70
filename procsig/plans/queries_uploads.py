"""Bound queries: uploaded files judged one by one (V1, V2, U3, W8), request defaults (T5, P10) and the model
store (S6). The files are written from lineitem, one folder per return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsig.operators import search as sr
from procsig.plans.queries_models import FEATS, KEEP, QUERY_TREES, ROW_ID, TUNED, _three
from procsig.plans.registry import register
from procsig.session import cut_lineage
from procsig.sources import io, store
from procsig.sources import uploads as up
from procsig.sources.tables import LINEITEM, table

LV = list(LINEITEM.variables)
_COLS = ["l_orderkey", "l_linenumber", "l_suppkey", *LV]


def _folder(spark, sf):
    """Whole rows as CSV files in the order of the orders: flag A complete; N without a column; R with text in a
    variable and gaps in a key; a folder of headers alone; a file that is no CSV."""
    folder = io.scratch_path(spark, "upload")
    li = table(spark, sf, "lineitem").select(*_COLS, "l_returnflag").repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber")
    odd = F.col("l_orderkey") % 5 == 0
    parts = {"a": li.where("l_returnflag = 'A'"), "n": li.where("l_returnflag = 'N'").drop("l_tax"),
             "r": li.where("l_returnflag = 'R'").withColumn("l_discount", F.when(odd, F.lit('none, "so far"')).otherwise(F.col("l_discount").cast("string")))
             .withColumn("l_suppkey", F.when(odd, F.lit(None)).otherwise(F.col("l_suppkey"))),
             "empty": li.limit(0)}
    for name, df in parts.items():
        io.write_csv(df.drop("l_returnflag"), f"{folder}/{name}")
    li.groupBy("l_returnflag").count().write.json(f"{folder}/other")
    return folder


_ROWS = """WITH l AS (SELECT lower(l_returnflag) AS source, l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' AND l_orderkey % 5 = 0 THEN NULL ELSE l_suppkey END AS run,
  lag(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS before FROM lineitem),
s AS (SELECT source, count(*) AS n_rows, count(DISTINCT run) AS n_runs, min(l_linenumber)::DOUBLE AS sample_min, max(l_linenumber)::DOUBLE AS sample_max,
  count(*) FILTER (WHERE before > l_linenumber) AS n_decreases, count(*) FILTER (WHERE run IS NULL) AS n_null, count(*) FILTER (WHERE l_orderkey % 5 = 0) AS n_odd
  FROM l GROUP BY source)"""


@register("validate_uploads", _ROWS + f"""
SELECT source, n_rows, CASE source WHEN 'n' THEN {len(_COLS) - 1} ELSE {len(_COLS)} END AS n_cols, n_runs, sample_min, sample_max,
       CASE WHEN source = 'n' THEN 'Missing feature columns: l_tax'
            WHEN source = 'r' AND n_odd > 0 THEN 'Non-numeric feature columns: l_discount | NULL values in key columns: l_suppkey' ELSE '' END AS errors,
       concat_ws(' | ', CASE WHEN n_decreases > 0 THEN 'Samples are not in ascending order' END,
                 CASE WHEN n_runs > 1 THEN 'Multiple runs found: ' || n_runs END) AS warnings,
       source = 'a' OR source = 'r' AND n_odd = 0 AS is_valid FROM s
UNION ALL SELECT 'empty', 0, NULL, 0, NULL, NULL, 'Need at least 3 rows, got 0', '', false""")
def validate_uploads(spark, sf):
    v = up.validate_folder(spark, _folder(spark, sf), "l_suppkey", "l_linenumber", LV, source=up.upload_folder())
    return v.select("source", "n_rows", "n_cols", "n_runs", "sample_min", "sample_max", F.array_join("errors", " | ").alias("errors"),
                    F.array_join("warnings", " | ").alias("warnings"), "is_valid")


@register("default_request", """
WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' AND l_orderkey % 5 = 0 THEN NULL ELSE l_suppkey END AS run FROM lineitem),
d AS (SELECT l_returnflag, arg_min([run], (l_orderkey, l_linenumber))[1] AS run, max(l_linenumber) AS target FROM l GROUP BY l_returnflag),
f AS (SELECT l.l_returnflag, count(*) AS n_rows, count(DISTINCT l_linenumber) AS n FROM l JOIN d ON l.l_returnflag = d.l_returnflag AND l.run = d.run
      WHERE l_linenumber BETWEEN target - 2 AND target GROUP BY l.l_returnflag)
SELECT lower(d.l_returnflag) AS source, run::VARCHAR AS run, target::BIGINT AS target, coalesce(n_rows, 0) AS n_rows, coalesce(n, 0) = 3 AS ok
FROM d LEFT JOIN f ON f.l_returnflag = d.l_returnflag""")
def default_request(spark, sf):
    """The ingest sequence survives Parquet and a shuffle: the first line's run is found over shuffled rows."""
    lines = up.read_lines(spark, _folder(spark, sf), up.upload_folder())
    path = io.scratch_path(spark, "ingested")
    up.records(lines, up.headers(lines)).drop("names").repartition("values").write.parquet(path)  # the names are the maps' keys
    rows = spark.read.parquet(path)
    return up.requested_window(rows, up.default_request(rows, "l_suppkey", "l_linenumber"), "l_suppkey", "l_linenumber")


@register("model_store", f"""
WITH s AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS sample FROM lineitem WHERE l_suppkey IS NOT NULL),
t AS (SELECT count(*) AS n_rows FROM s, (SELECT min(l_suppkey) + 0.8 * (max(l_suppkey) - min(l_suppkey)) AS c FROM lineitem) WHERE sample >= 3 AND l_suppkey > c)
SELECT unnest([{', '.join(f"'{k}'" for k in TUNED)}]) AS model, 2 AS version, n_rows, 0::BIGINT AS n_different FROM t""")
def model_store(spark, sf):
    """Every detector saved twice and read back: the latest version scores all test rows as before."""
    train, val, test = _three(spark, sf)
    params = {k: p | QUERY_TREES.get(k, {}) for k, p in TUNED.items()} | {"boosted": {"maxIter": 4, "maxDepth": 3}}
    fitted = sr.final_fit(train, val, FEATS, params, row_id=ROW_ID)
    path, latest = io.scratch_path(spark, "models"), {}
    for kind, d in fitted.items():
        for _ in range(2):
            latest[kind] = store.save_detector(spark, d, f"{path}/{kind}")
    back = {k: store.load_detector(spark, f"{path}/{k}") for k in fitted}
    before = cut_lineage(sr.detector_scores(fitted, test, KEEP))
    after = sr.detector_scores(back, test, KEEP).select("model", *ROW_ID, F.col("prediction").alias("p"), F.col("score").alias("s"))
    both = before.join(after, ["model", *ROW_ID])
    version = F.element_at(F.create_map(*[x for k, v in latest.items() for x in (F.lit(k), F.lit(v))]), F.col("model"))
    return both.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("p").eqNullSafe(F.col("prediction")) | ~F.col("s").eqNullSafe(F.col("score"))).alias("n_different")) \
        .select("model", version.alias("version"), "n_rows", "n_different")
