import math

from pyspark.sql import functions as F

from procsig.functions.scalar import cache_key, round_half_even
from procsig.operators import profile as pf
from procsig.operators import stats as st

NAN = float("nan")


def test_half_even_without_saturation(spark):
    rows = [(1e13, 6, 1e13), (0.125, 2, 0.12), (-1.5, 0, -2.0), (2.5, 0, 2.0), (0.375, 2, 0.38), (-0.125, 2, -0.12)]
    for x, d, want in rows:
        assert spark.range(1).select(round_half_even(F.lit(x), d)).first()[0] == want == round(x, d)
    out = spark.range(1).select(round_half_even(F.lit(NAN), 3), round_half_even(F.lit(float("inf")), 3), round_half_even(F.lit(None), 3)).first()
    assert math.isnan(out[0]) and out[1] == float("inf") and out[2] is None


def test_cache_key_rounds_like_python(spark):
    import hashlib
    got = spark.range(1).select(cache_key(F.lit(0.125), F.array(F.lit("b"), F.lit("a")))).first()[0]
    assert got == hashlib.md5(f"{round(0.125, 2)}_{sorted(['b', 'a'])}".encode()).hexdigest()


def _frame(spark):
    return spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (NAN, "b"), (None, "a")], "x double, c string")


def test_statistics_skip_nan(spark):
    df = _frame(spark)
    r = pf.describe(df, ["x"]).first()
    assert (r["count"], r["mean"], r["std"], r["min"], r["q50"], r["max"]) == (3, 2.0, 1.0, 1.0, 2.0, 3.0)
    v = {r["category"]: r for r in st.variability(df, ["x"], "c").collect()}
    assert v["a"]["mean"] == 1.5 and v["b"]["mean"] == 3.0 and v["b"]["range"] == 0.0
    b = {r["category"]: r for r in st.box_stats(df, ["x"], "c").collect()}
    assert b["a"]["n"] == 2 and b["b"]["n"] == 1 and b["b"]["n_outliers"] == 0
    assert st.normal_fit(df, "x", 3).first()["mu"] == 2.0
    assert {r["transform"]: r["n"] for r in st.transform_moments(df, "x").collect()} == {"raw": 3, "sqrt": 3, "log": 3}
    two = spark.createDataFrame([(0.0, 0), (0.0, 0), (1.0, 1), (1.0, 1), (NAN, 1)], "x double, y int")
    assert abs(st.mutual_information(two, ["x"], "y").first()["mi"] - math.log(2)) < 1e-12


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([(0.0, "a"), (10.0, "b"), (NAN, "a"), (None, "b")], "x double, c string")
    rows = {r["bin"]: r["count"] for r in st.histogram(df, "x", 5).collect()}
    assert rows == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}
    assert st.histogram(df, "x", 5, hue="c").count() == 10
    assert st.histogram(df.where("x IS NULL"), "x", 5).agg(F.sum("count")).first()[0] == 0


def test_bucketed_quantiles_with_a_hot_value(spark):
    df = spark.range(3000).selectExpr("'g' AS g", "CASE WHEN id % 3 = 0 THEN 7.0 ELSE cast(id AS double) END AS v")
    q = st.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.999, 1.0], max_in_memory_distinct=None).first()
    w = df.groupBy().agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.999, 1.0)]))).first()[0]
    assert [q[f"q{i}"] for i in range(5)] == w


def test_csv_keeps_quotes_and_microseconds(spark):
    import datetime as dt

    from pyspark.sql import types as T

    from procsig.sources import io
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("s", T.StringType())])
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, 7, 179575), 'say "hi", {"k": 1}'), (2, None, "a\\b"), (3, dt.datetime(2024, 1, 1), None)]
    path = io.scratch_path(spark, "quotes")
    io.write_csv(spark.createDataFrame(rows, schema), path)
    back = io.read_csv(spark, path, schema)
    got = sorted(tuple(r) for r in back.collect())
    assert got == [(*r, None) for r in rows]
