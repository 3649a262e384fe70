import random
import struct

import pytest
from pyspark.sql import functions as F

from procsig.operators import features as fe
from procsig.plans.analysis import serving_features
from procsig.session import cut_lineage, cut_lineage_packed
from procsig.spec import SeriesSpec

SPEC = SeriesSpec(("k",), ("t", "u"))


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    rows = [(k, t // 2, t, rng.choice(odd) if rng.random() < 0.3 else rng.gauss(0, 1e3), 0.1 * rng.randrange(9), t % 4 == 0)
            for k in range(9) for t in range(40)]
    df = spark.createDataFrame(rows, "k long, t long, u long, a double, b double, label boolean")
    return cut_lineage(fe.with_sample_number(df, SPEC))


def bits(df, columns):
    return sorted(tuple(struct.pack(">d", v) if isinstance(v, float) and v == v else repr(v).encode() for v in r) for r in df.select(*columns).collect())


def test_projections_of_lags_are_the_windows_to_the_last_bit(samples):
    names = fe.feature_names(["a", "b"])
    want = samples.select("*", *fe.lag_exprs(SPEC, ["a", "b"], (1, 2)), *fe.rolling_exprs(SPEC, ["a", "b"], (3,)), *fe.diff_exprs(SPEC, ["a", "b"]))
    for given in ({}, {"chunks": 3}, {"stored": ["k", "sample", "label"]}, {"chunks": 3, "stored": ["k", "sample", "label"]}):
        got = serving_features(samples, SPEC, ["a", "b"], **given)
        assert bits(got, ["k", "sample", "label", *names]) == bits(want, ["k", "sample", "label", *names])
        whole = [~F.isnan(c) & F.col(c).isNotNull() for c in names]
        assert got.where("ok").count() == samples.where("sample >= 3").join(want.where(" AND ".join("true" for _ in whole)).where(
            F.forall(F.array(*whole), lambda x: x)).select("k", "sample"), ["k", "sample"]).count() > 0


def test_complete_rows_alone_are_the_ok_ones(samples):
    names = ["k", "sample", "label", *fe.feature_names(["a", "b"])]
    some = serving_features(samples, SPEC, ["a", "b"], stored=["k", "sample", "label"], complete_only=True)
    want = serving_features(samples, SPEC, ["a", "b"]).where("ok")
    assert bits(some.where("ok"), names) == bits(want, names) and 0 < some.count() < samples.count()


def test_packed_rows_keep_their_partitions_and_order(spark):
    df = spark.range(25_000).repartition(3, "id").selectExpr("id", "cast(id % 7 AS string) AS s", "timestamp_micros(id) AS t", "if(id % 3 = 0, null, id % 2 = 0) AS b")
    got, want = (x.withColumn("p", F.spark_partition_id()) for x in (cut_lineage_packed(df), df))
    assert got.schema == want.schema and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_stored_features_are_small_on_disk(spark, tmp_path, monkeypatch):
    """The features of 4 variables are 32 doubles a row; what is written of them is less than a quarter."""
    from procsig.plans import analysis
    written = []
    monkeypatch.setattr(analysis, "cut_lineage_packed", lambda df, *then: written.append(len(df.columns)) or cut_lineage_packed(df, *then))
    df = spark.range(900).selectExpr("id % 9 AS k", "id AS t", "id AS u", *[f"cast(id % {n} AS double) AS v{n}" for n in (3, 5, 7, 11)], "id % 2 = 0 AS label")
    vs = ["v3", "v5", "v7", "v11"]
    got = serving_features(fe.with_sample_number(df, SPEC), SPEC, vs, stored=["k", "sample", "label"])
    assert written == [3 + 3 * 4 + 1] and set(fe.feature_names(vs)) <= set(got.columns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
