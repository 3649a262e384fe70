import os

import pytest
from pyspark.sql import functions as F

from procsig.sources import uploads as up

FEATURES = ["v1", "v2"]


@pytest.fixture()
def folder(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
    put("good.csv", "run,sample,v1,v2\n2,1,0.5,1\n2,2,,1e3\n2,3,0.1,-4\n")
    put("lacks.CSV", "sample,run,v1\n5,1,1\n4,1,2\n6,2,3\n")
    put("text.csv", '"run","sample",v1,v2\n1,1,"so ""far"", odd",1\n,2,2,2\n1,3,3,nan text\n1,4,3\n')
    put("short.csv", "run,sample,v1\n1,1,x\n")
    put("header.csv", "run,sample,v1,v2\n")
    put("notes.txt", "run,sample\n1,2\n")
    os.makedirs(tmp_path / "deep")
    put("deep/more.csv", "﻿run,sample,v1,v2,extra\n\n7,3,1,2,3,4\n7,2,1,2\n7,9,1,2,3\n")
    return str(tmp_path)


def report(spark, folder):
    return {r["source"]: r for r in up.validate_folder(spark, folder, "run", "sample", FEATURES).collect()}


def test_every_file_is_judged_by_its_own_header(spark, folder):
    got = report(spark, folder)
    assert set(got) == {"good.csv", "lacks.CSV", "text.csv", "short.csv", "header.csv", "more.csv"}
    assert got["good.csv"]["is_valid"] and not got["good.csv"]["errors"] and not got["good.csv"]["warnings"]
    assert got["lacks.CSV"]["errors"] == ["Missing feature columns: v2"]
    assert got["lacks.CSV"]["warnings"] == ["Samples are not in ascending order", "Multiple runs found: 2"]
    assert got["text.csv"]["errors"] == ["Non-numeric feature columns: v1, v2", "NULL values in key columns: run"]
    assert got["short.csv"]["errors"] == ["Need at least 3 rows, got 1"] and not got["short.csv"]["warnings"]
    assert got["header.csv"]["errors"] == ["Need at least 3 rows, got 0"] and not got["header.csv"]["is_valid"]
    assert got["more.csv"]["is_valid"] and got["more.csv"]["warnings"] == ["Samples are not in ascending order"]
    assert (got["more.csv"]["n_rows"], got["more.csv"]["n_cols"], got["more.csv"]["sample_max"]) == (3, 5, 9.0)


def test_order_and_first_run_survive_parquet_shuffles_and_blocks(spark, tmp_path):
    lines = ["run,sample,v1,v2"] + [f"{(i * 37 + 5) % 11},{i + (3 if i == 500 else 0)},1,2" for i in range(1000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # many blocks of one file
    try:
        read = up.read_lines(spark, str(tmp_path / "in"))
        rows = up.records(read, up.headers(read))
        assert rows.select("ingest_seq.block").distinct().count() > 5
        rows.repartition(7, "values").write.parquet(str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = spark.read.parquet(str(tmp_path / "p"))
    r = up.default_request(rows, "run", "sample").first()
    assert (r["run"], r["target"]) == ("5", 999)
    assert up.in_file_order(rows.select("source", "file", "ingest_seq", F.col("values")["sample"].cast("double").alias("sample"))).first()["n_decreases"] == 1
    got = up.requested_window(rows, up.default_request(rows, "run", "sample"), "run", "sample").first()
    assert got["n_rows"] == sum((i * 37 + 5) % 11 == 5 for i in range(997, 1000)) and not got["ok"]


def test_window_of_the_default_request(spark, folder):
    lines = up.read_lines(spark, folder)
    rows = up.records(lines, up.headers(lines))
    got = {r["source"]: r for r in up.requested_window(rows, up.default_request(rows, "run", "sample"), "run", "sample").collect()}
    assert (got["good.csv"]["run"], got["good.csv"]["target"], got["good.csv"]["ok"]) == ("2", 3, True)
    assert got["lacks.CSV"]["run"] == "1" and got["lacks.CSV"]["target"] == 6 and not got["lacks.CSV"]["ok"]


def test_lines_are_neither_sorted_nor_gathered_by_file(spark, folder):
    lines = up.read_lines(spark, folder, up.upload_folder())
    assert {r["source"] for r in lines.select("source").distinct().collect()} == {os.path.basename(folder), "deep"}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan(lines)
    heads = up.headers(lines)
    rows = up.records(lines, heads)
    assert not any(x in plan(df) for df in (heads, rows) for x in ("SortAggregate", "SortMergeJoin", "Exchange hashpartitioning"))
    request = up.default_request(rows, "run", "sample")
    assert "SortMergeJoin" not in plan(request)
    assert {r["source"]: r["target"] for r in request.collect()} == {os.path.basename(folder): 6, "deep": 9}
