"""Bound queries: sources and sinks (S1-S6), round-tripping Spark-derived data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsig.operators.detect import fit_scaler
from procsig.plans.bound import E_FEATS, events_features, events_scored_sql
from procsig.plans.registry import register, rounded
from procsig.plans.sqlgen import q
from procsig.sources import io
from procsig.sources.tables import table

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
LI_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
    T.StructField("l_quantity", T.DoubleType()),
])


@register("csv_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props, NULL::VARCHAR AS _corrupt_record FROM events")
def csv_roundtrip(spark, sf):
    path = io.scratch_path(spark, "events-csv")
    io.write_csv(table(spark, sf, "events"), path)
    back = io.read_csv(spark, path, EVENT_SCHEMA)
    return back.select(*EVENT_SCHEMA.names, io.CORRUPT)


@register("uploaded_csv_scan", "SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def uploaded_csv_scan(spark, sf):
    folder = io.scratch_path(spark, "uploads")
    ev = table(spark, sf, "events")
    # one folder of files per event type, whatever types the table holds
    io.write_csv(ev.select(*EVENT_SCHEMA.names, F.coalesce("event_type", F.lit("none")).alias("upload")), f"{folder}/csv", ["upload"])
    # a file with another suffix in the same folder must be ignored by the scan
    ev.groupBy("event_type").count().write.mode("overwrite").json(f"{folder}/not_csv")
    up = io.read_uploaded_csv(spark, folder, EVENT_SCHEMA)
    return up.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


@register("batch_convert", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'training' ELSE 'testing' END AS split,
       CASE WHEN l_returnflag = 'R' THEN 'faulty' ELSE 'fault_free' END AS condition
FROM lineitem""")
def batch_convert(spark, sf):
    folder = io.scratch_path(spark, "convert")
    li = table(spark, sf, "lineitem").select(*[f.name for f in LI_SCHEMA.fields])
    sources = {}
    for training, split in ((True, "training"), (False, "testing")):
        for faulty, cond in ((True, "faulty"), (False, "fault_free")):
            part = li.filter((F.col("l_linestatus").eqNullSafe("F") == F.lit(training)) & (F.col("l_returnflag").eqNullSafe("R") == F.lit(faulty)))
            path = f"{folder}/src_{split}_{cond}"
            io.write_csv(part, path)
            sources[(split, cond)] = path
    out = io.convert_sources(spark, sources, LI_SCHEMA, f"{folder}/table")
    return out.select("l_orderkey", "l_linenumber", "split", "condition")


@register("filter_materialise", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
WHERE l_returnflag IN ('R', 'A') AND l_linenumber <= 4""")
def filter_materialise(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return io.filter_and_materialise(li, "l_returnflag", ["R", "A"], "l_linenumber", 4,
                                     io.scratch_path(spark, "filtered"))


@register("params_roundtrip", events_scored_sql() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, round({q(f + '__m')}, 6) AS mean, round({q(f + '__sd')}, 6) AS std FROM fit"
    for f in E_FEATS))
def params_roundtrip(spark, sf):
    feats = events_features(spark, sf).filter(F.col("split") == "train")
    scaler = fit_scaler(feats, E_FEATS)
    path = io.scratch_path(spark, "scaler")
    io.save_moments(spark, scaler, path)
    back = io.load_moments(spark, path)
    rows = [(f, back.mean[f], back.std[f]) for f in back.features]
    return rounded(spark.createDataFrame(rows, "feature string, mean double, std double"), 6)
