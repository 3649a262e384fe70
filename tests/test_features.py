import math
import random

from pyspark.sql import functions as F

from procsig import SeriesSpec
from procsig.operators import features as fe
from procsig.operators import prepare as pr

SPEC = SeriesSpec(("run",), ("t",))


def frame(spark, rows):
    return spark.createDataFrame(rows, "run int, t int, x double, other string")


def series(run, n, start=1, other="a"):
    return [(run, t, float(t * t), other) for t in range(start, start + n)]


def test_rolling_std_null_on_first_row_and_lags(spark):
    df = frame(spark, series(1, 3))
    out = fe.rolling_features(df, SPEC, (3,), ["x"], dropna=False).orderBy("t").collect()
    assert out[0]["x_rolling_std_3"] is None
    assert out[1]["x_rolling_mean_3"] == 2.5
    assert math.isclose(out[2]["x_rolling_std_3"], (sum((v - 14 / 3) ** 2 for v in (1, 4, 9)) / 2) ** 0.5)
    lag = fe.lag_features(df, SPEC, (1, -1), ["x"], dropna=False).orderBy("t").collect()
    assert lag[0]["x_lag_1"] is None and lag[1]["x_lag_1"] == 1.0 and lag[1]["x_lag_-1"] == 9.0


def test_serving_keeps_rows_from_3_and_train_from_5(spark):
    rows = series(1, 1) + series(2, 2) + series(3, 3) + series(4, 5)
    df = frame(spark, rows)
    serving = fe.feature_chain_serving(df, SPEC, ["x"])
    assert sorted((r.run, r.t) for r in serving.collect()) == [(3, 3), (4, 3), (4, 4), (4, 5)]
    train = fe.feature_chain_train(df, SPEC, ["x"])
    assert sorted((r.run, r.t) for r in train.collect()) == [(4, 5)]


def test_null_anywhere_drops_row_and_later_stage_sees_shorter_series(spark):
    rows = series(1, 6)
    rows[3] = (1, 4, None, "a")           # NULL in the variable
    rows[1] = (1, 2, 4.0, None)           # NULL in an unrelated column
    df = frame(spark, rows)
    out = fe.lag_features(df, SPEC, (1,), ["x"], dropna=True).collect()
    assert sorted(r.t for r in out) == [3, 6]  # t=2 (other NULL), t=4 (x NULL), t=5 (lag NULL) dropped
    chain = fe.feature_chain_train(df, SPEC, ["x"])
    assert chain.count() == 0


def test_nan_dropped_like_null(spark):
    df = frame(spark, [(1, 1, 1.0, "a"), (1, 2, float("nan"), "a"), (1, 3, 3.0, "a")])
    assert pr.drop_missing(df).count() == 2
    assert pr.nan_to_null(df).filter(F.col("x").isNull()).count() == 1


def test_no_leak_across_series_and_null_keys_dropped(spark):
    rows = [(1, t, float(t), "a") for t in range(1, 4)] + [(2, t, 100.0 + t, "a") for t in range(1, 4)]
    rows.append((None, 9, 5.0, "a"))
    df = frame(spark, rows)
    out = {(r.run, r.t): r.x_lag_1 for r in fe.lag_features(df, SPEC, (1,), ["x"], dropna=False).collect()}
    assert out[(2, 1)] is None and out[(2, 2)] == 101.0 and (None, 9) not in out


def test_grouping_with_two_faults_sharing_a_run(spark):
    df = spark.createDataFrame([(0, 1, 1, 1.0), (0, 1, 2, 2.0), (1, 1, 1, 10.0), (1, 1, 2, 20.0)],
                               "fault int, run int, t int, x double")
    safe = fe.lag_features(df, SeriesSpec(("fault", "run"), ("t",)), (1,), ["x"], dropna=False)
    assert {(r.fault, r.t): r.x_lag_1 for r in safe.collect()}[(1, 1)] is None


def test_shuffled_input_gives_same_result(spark):
    rows = series(1, 8) + series(2, 6)
    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    a = fe.feature_chain_serving(frame(spark, rows), SPEC, ["x"]).orderBy("run", "t").collect()
    b = fe.feature_chain_serving(frame(spark, shuffled).repartition(3), SPEC, ["x"]).orderBy("run", "t").collect()
    assert a == b


def test_sequence_check_flags_gaps(spark):
    df = spark.createDataFrame([(1, s) for s in (5, 6, 7, 8, 10, 11, 12)], "run int, sample int")
    out = {r.sample: r.seq_ok for r in pr.analysis_sequence_check(df, SeriesSpec(("run",), ("sample",))).collect()}
    assert out[7] and out[8] and not out[10] and not out[11] and out[12] and not out[5]


def test_chunked_window_equals_global_window(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50), rng.random()) for i in range(2000)]  # many ties on t
    df = spark.createDataFrame(rows, "id int, t int, x double")
    spec = SeriesSpec((), ("t", "id"))

    def build(s):
        return fe.lag_exprs(s, ["x"], (1, 2)) + fe.rolling_exprs(s, ["x"], (3,))

    got = fe.chunked_window(df, spec, halo=2, build=build, n_chunks=8).orderBy("id").collect()
    want = df.select("*", *build(spec)).orderBy("id").collect()
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for k in a.asDict():
            va, vb = a[k], b[k]
            assert (va is None and vb is None) or math.isclose(va, vb, rel_tol=1e-12, abs_tol=1e-12), (k, va, vb)


def test_chunked_window_per_hot_key(spark):
    rows = [(0, t, float(t % 7)) for t in range(3000)] + [(1, t, float(t)) for t in range(5)]
    df = spark.createDataFrame(rows, "k int, t int, x double")
    spec = SeriesSpec(("k",), ("t",))

    def build(s):
        return fe.diff_exprs(s, ["x"]) + fe.rolling_exprs(s, ["x"], (4,), ("sum",))

    got = {(r.k, r.t): (r.x_diff, r.x_rolling_sum_4) for r in fe.chunked_window(df, spec, 3, build, 16).collect()}
    want = {(r.k, r.t): (r.x_diff, r.x_rolling_sum_4) for r in df.select("*", *build(spec)).collect()}
    assert got == want


def test_onset_label_is_strict(spark):
    df = spark.createDataFrame([(1, 20, "training"), (1, 21, "training"), (1, 160, "testing"), (1, 161, "testing"),
                                (0, 500, "testing")], "fault int, sample int, split string")
    out = pr.onset_label(df, "fault", "sample", pr.split_onset("split")).collect()
    assert [r.faulty for r in out] == [False, True, False, True, False]


def test_feature_catalog_and_names(spark):
    cat = fe.feature_catalog(spark, ["a", "b"])
    assert cat.count() == 2 * 8
    assert set(fe.feature_names(["a"])) == {r.feature for r in cat.filter("base = 'a'").collect()}


def test_chunked_row_number_is_exact_on_hot_key_with_ties(spark):
    rng = random.Random(9)
    rows = [(0, rng.randint(0, 40), i) for i in range(4000)] + [(1, t, 10_000 + t) for t in range(7)]
    df = spark.createDataFrame(rows, "k int, t int, id int")
    spec = SeriesSpec(("k",), ("t", "id"))
    got = {r.id: r.sample for r in fe.with_sample_number(df, spec, chunks=16).collect()}
    want = {r.id: r.sample for r in fe.with_sample_number(df, spec).collect()}
    assert got == want


def test_chunk_options_give_same_results(spark):
    from procsig.operators import report as rp
    from procsig.operators import validate as va
    rng = random.Random(4)
    rows = [(0, s, rng.random()) for s in range(1, 3001) if s % 97 != 0] + [(1, s, 1.0) for s in range(1, 6)]
    df = spark.createDataFrame(rows, "run int, sample int, x double")
    spec = SeriesSpec(("run",), ("sample",))
    a = {(r.run, r.sample): r.seq_ok for r in pr.analysis_sequence_check(df, spec).collect()}
    b = {(r.run, r.sample): r.seq_ok for r in pr.analysis_sequence_check(df, spec, chunks=8).collect()}
    assert a == b and not a[(0, 98)]
    p1 = sorted((r.run, r.sample, r.pos) for r in pr.positional_slice(df, spec, 100, 105).collect())
    p2 = sorted((r.run, r.sample, r.pos) for r in pr.positional_slice(df, spec, 100, 105, chunks=8).collect())
    assert p1 == p2 and len(p1) == 5
    h1 = {r.sample: [i.sample for i in r.history] for r in rp.history_window(df, ["run"], "sample", F.struct("sample"), 3).collect()}
    h2 = {r.sample: [i.sample for i in r.history] for r in rp.history_window(df, ["run"], "sample", F.struct("sample"), 3, chunks=8).collect()}
    assert h1 == h2
    src = df.select(F.lit("s").alias("src"), F.col("sample").alias("seq"), (F.col("sample") % 50).alias("sample"))
    o1 = va.order_breaks(src, "src", ["seq"], "sample").first()
    o2 = va.order_breaks(src, "src", ["seq"], "sample", chunks=8).first()
    assert o1 == o2 and o1.n_decreases > 0


def test_process_ingest_label_and_features(spark):
    from procsig.sources import process as ps
    rows = []
    for fault, run in ((0, 1), (13, 1)):
        for s in range(1, 26):
            rows.append(tuple([float(fault), float(run), float(s)] + [float(s * (i + 1) + fault) for i in range(52)]))
    rows[3] = tuple(list(rows[3][:3]) + [float("nan")] + list(rows[3][4:]))
    df = ps.ingest(spark.createDataFrame(rows, ps.SCHEMA), split="training")
    lab = ps.run_split(ps.label(df))
    got = {(r.faultNumber, r.sample): r.faulty for r in lab.collect()}
    assert got[(13, 20)] is False and got[(13, 21)] is True and got[(0, 25)] is False
    assert lab.filter(F.col("xmeas_1").isNull()).count() == 1
    feats = fe.feature_chain_serving(lab, ps.SPEC, ["xmeas_1", "xmv_11"])
    # fault 0 loses rows 1-2 and the NaN row plus the two after it (lags/rolling see it); fault 13 keeps 3..25
    assert feats.filter("faultNumber = 13").count() == 23 and feats.filter("faultNumber = 0").count() == 23 - 3


def test_series_chunks_checks_largest_series(spark):
    df = spark.createDataFrame([(0, i) for i in range(1000)] + [(1, i) for i in range(10)], "k int, t int")
    spec = SeriesSpec(("k",), ("t",))
    assert fe.series_chunks(df, spec, target_rows=5000) == 1
    assert fe.series_chunks(df, spec, target_rows=100) == 10
    assert fe.series_chunks(df, spec, target_rows=1) == 1000


def test_lonely_row_between_two_busy_time_stamps(spark):
    """Chunks shorter than the halo: the look-back reaches over several earlier chunks."""
    rows = [(1, 0 if i < 500 else 2, i, float(i)) for i in range(1000) if i != 500] + [(1, 1, 500, 500.0)]
    rows += [(2, i, i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, t int, id int, x double")
    spec = SeriesSpec(("k",), ("t", "id"))

    def build(s):
        return fe.lag_exprs(s, ["x"], (1, 2, 3)) + fe.rolling_exprs(s, ["x"], (3,))

    plain = {(r.k, r.id): tuple(r) for r in df.select("*", *build(spec)).collect()}
    for n in (2, 8):
        got = {(r.k, r.id): tuple(r) for r in fe.chunked_window(df, spec, 3, build, n).collect()}
        assert got == plain


def test_random_short_chunks_equal_the_plain_window(spark):
    import random
    rnd = random.Random(3)
    rows = [(1, rnd.choice([1, 1, 1, 5, 9, rnd.randrange(40)]), i, rnd.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, t int, id int, x double")
    spec = SeriesSpec(("k",), ("t", "id"))
    build = lambda s: fe.lag_exprs(s, ["x"], (1, 4)) + fe.diff_exprs(s, ["x"])
    plain = {r.id: tuple(r) for r in df.select("*", *build(spec)).collect()}
    for halo, n in ((4, 16), (4, 28), (7, 9)):
        assert {r.id: tuple(r) for r in fe.chunked_window(df, spec, halo, build, n).collect()} == plain


def test_three_hundred_chunks(spark):
    df = spark.range(6000).selectExpr("1 AS k", "id AS t", "cast(id * 3 % 17 AS double) AS x")
    spec = SeriesSpec(("k",), ("t",))
    build = lambda s: fe.lag_exprs(s, ["x"], (1, 2))
    plain = {r.t: tuple(r) for r in df.select("*", *build(spec)).collect()}
    assert {r.t: tuple(r) for r in fe.chunked_window(df, spec, 2, build, 300).collect()} == plain


def test_every_window_operator_in_chunks_equals_the_plain_form(spark):
    import random

    from procsig.operators import prepare as pr
    from procsig.operators import report as rp
    from procsig.operators import validate as va
    rnd = random.Random(9)
    rows = [(1 if i % 3 else 2, rnd.randrange(300), i, rnd.random() if i % 17 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, t int, id int, x double")
    spec = SeriesSpec(("k",), ("t", "id"))
    s = fe.with_sample_number(df, spec)
    forms = [
        lambda c: fe.with_sample_number(df, spec, chunks=c), lambda c: fe.lag_features(df, spec, (1, 2), ["x"], chunks=c),
        lambda c: fe.lag_features(df, spec, (-1,), ["x"], chunks=c), lambda c: fe.rolling_features(df, spec, (3,), ["x"], chunks=c),
        lambda c: fe.diff_features(df, spec, ["x"], chunks=c), lambda c: fe.feature_chain_train(df, spec, ["x"], chunks=c),
        lambda c: fe.feature_chain_serving(df, spec, ["x"], chunks=c), lambda c: pr.analysis_sequence_check(s, spec, chunks=c),
        lambda c: pr.positional_slice(df, spec, 5, 40, chunks=c), lambda c: rp.history_window(s, ["k"], "sample", F.col("id"), 3, chunks=c),
        lambda c: va.order_breaks(df, "k", ["t", "id"], "id", chunks=c)]
    for f in forms:
        plain = sorted(map(repr, f(1).collect()))
        assert sorted(map(repr, f(5).collect())) == plain and sorted(map(repr, f("auto").collect())) == plain


def test_look_ahead_over_chunks_of_any_size(spark):
    """Leads and lags over chunks down to one row equal the plain window; short series stay whole."""
    rows = [("hot", i, float(i * i % 17)) for i in range(200)] + [("small", i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(5)
    spec = SeriesSpec(("k",), ("t",))
    tagged = {"one row": F.col("t"), "short": F.floor(F.col("t") / 3), "uneven": F.when(F.col("t") < 150, F.floor(F.col("t") / 40)).otherwise(F.col("t"))}
    for lags in ((-1,), (-4, 2), (3, -1, -7)):
        build = lambda s: fe.lag_exprs(s, ["x"], lags)  # noqa: E731, B023
        want = {(r.k, r.t): tuple(r) for r in df.select("*", *build(spec)).collect()}
        for chunk in tagged.values():
            out = fe.windowed_chunks(df.withColumn("_chunk", chunk.cast("int")), spec, max(0, *lags), build, max(-k for k in lags))
            assert {(r.k, r.t): tuple(r)[:len(want[r.k, r.t])] for r in out.drop("_chunk").collect()} == want
        got = fe.lag_features(df, spec, lags, ["x"], dropna=False, chunks=6)
        assert {(r.k, r.t): tuple(r) for r in got.collect()} == want


def test_series_are_spread_by_their_rows(spark):
    from procsig.operators import features as fe
    from procsig.spec import SeriesSpec
    spec = SeriesSpec(("s",), ("t",))
    df = spark.range(1000).selectExpr("id % 50 AS s", "id AS t", "id * 1.0D AS v")
    spread = fe.spread_series(df, spec, target_rows=100)
    numbered = fe.with_sample_number(spread, spec)
    assert spread.rdd.getNumPartitions() == 10
    assert numbered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, fe.with_sample_number(df, spec).collect()))
    assert fe.spread_series(df, spec) is df


def test_series_compare_averages_before_it_unpivots(spark):
    from procsig.operators import stats as st
    nan = float("nan")
    df = spark.createDataFrame([("x", 1, 1, 2.0, nan), ("x", 1, 1, 4.0, 5.0), ("x", 1, 4, None, None), (None, 2, 4, 1.0, 2.0)],
                               "cat string, s int, x int, a double, b double")
    out = st.series_compare(df, ["a", "b"], "cat", "s", "x", 3)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        ("a", "x", 1, 1, 3.0, False), ("b", "x", 1, 1, 5.0, False), ("a", "x", 1, 4, None, True), ("b", "x", 1, 4, None, True),
        ("a", None, 2, 4, 1.0, True), ("b", None, 2, 4, 2.0, True)], key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("HashAggregate")  # the plan prints its last step first
