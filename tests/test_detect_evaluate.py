import itertools
import math
import random

from pyspark.sql import functions as F

from procsig.functions.scalar import percent_text, tier
from procsig.operators import detect as dt
from procsig.operators import evaluate as ev
from procsig.operators import stats as st


def test_constant_feature_guards(spark):
    df = spark.createDataFrame([(1.0, float(i), False) for i in range(5)], "c double, x double, label boolean")
    scaler, z = dt.fit_scaled_zscore(df, ["c", "x"], ~F.col("label"))
    assert scaler.std["c"] == 1.0 and z.std["c"] == 1e-6
    corr = st.correlation_matrix(df, ["c", "x"]).collect()
    assert {(r.var_a, r.var_b): r.corr for r in corr}[("c", "x")] is None


def test_z_at_threshold_predicts_zero_with_half_probability(spark):
    model = dt.Moments({"x": 0.0}, {"x": 1.0})
    df = spark.createDataFrame([(2.0,), (-2.5,)], "x double")
    out = dt.zscore_score(df, model, 2.0).orderBy("x").collect()
    assert out[1].prediction == 0 and out[1].confidence == 0.5
    assert out[0].prediction == 1


def test_importances_sum_to_one(spark):
    imp = dt.zscore_importance(dt.Moments({"a": 0, "b": 0}, {"a": 1.0, "b": 3.0}))
    assert math.isclose(sum(imp.values()), 1.0) and imp["a"] > imp["b"]


def test_tiers_and_percent_text(spark):
    df = spark.createDataFrame([(0.4999,), (0.5,), (0.7499,), (0.75,), (0.1225,)], "c double")
    out = df.select(tier("c").alias("t"), percent_text("c").alias("p")).collect()
    assert [r.t for r in out] == ["NORMAL", "CAUTION", "CAUTION", "ALERT", "NORMAL"]
    assert out[4].p == "12.2%" and out[3].p == "75.0%"


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_brute_force_with_ties_and_is_rank_invariant(spark):
    rng = random.Random(5)
    pairs = [(float(rng.randint(0, 30)), rng.random() < 0.3) for _ in range(600)]
    df = spark.createDataFrame(pairs, "score double, label boolean")
    got = ev.roc_auc(df, buckets=16).first().auc
    assert math.isclose(got, _brute_auc(pairs), rel_tol=1e-12)
    mono = ev.roc_auc(df.select((F.col("score") * 3 + 7).alias("score"), "label"), buckets=16).first().auc
    assert math.isclose(mono, got, rel_tol=1e-12)


def test_auc_single_class_is_null_and_grouped(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("b", 1.0, False), ("b", 3.0, True)],
                               "model string, score double, label boolean")
    out = {r.model: r.auc for r in ev.roc_auc(df, by=["model"]).collect()}
    assert out["a"] is None and out["b"] == 1.0


def test_no_predicted_positive_gives_zero_precision_and_f1(spark):
    df = spark.createDataFrame([(True, 0), (False, 0)], "label boolean, prediction int")
    r = ev.precision_recall_f1(df).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    c = ev.confusion(df).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (0, 0, 1, 1)


def test_threshold_sweep_matches_brute_force(spark):
    rng = random.Random(11)
    pairs = [(rng.random() * 5, rng.random() < 0.4) for _ in range(400)] + [(2.0, True), (3.0, False)]
    df = spark.createDataFrame(pairs, "score double, label boolean")
    ts = ev.linspace(1.0, 5.0, 9)
    got = {round(r.threshold, 9): (r.tp, r.fp, r.tn, r.fn) for r in ev.threshold_sweep(df, ts).collect()}
    for t in ts:
        tp = sum(1 for s, y in pairs if s > t and y)
        fp = sum(1 for s, y in pairs if s > t and not y)
        P = sum(1 for _, y in pairs if y)
        assert got[round(t, 9)] == (tp, fp, len(pairs) - P - fp, P - tp)
    best = ev.best_threshold(ev.threshold_sweep(df, ts)).first()
    assert best.f1 == max(r.f1 for r in ev.threshold_sweep(df, ts).collect())


def test_roc_curve_ends_at_one(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "score double, label boolean")
    pts = sorted((r.fpr, r.tpr) for r in ev.roc_curve(df).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0) and len(pts) == 4  # the origin and one point per score


def test_histogram_last_bin_and_probabilities(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "x double")
    h = ev_rows = st.histogram(df, "x", bins=5).collect()
    assert math.isclose(sum(r.probability for r in h), 1.0)
    assert {r.bin: r["count"] for r in ev_rows}[4] == 1  # the maximum lands in the last bin


def test_cv_zero_mean_is_zero(spark):
    df = spark.createDataFrame([(-1.0, "a"), (1.0, "a")], "x double, c string")
    assert st.variability(df, ["x"], "c").first().cv == 0.0


def test_mutual_information_independent_is_zero(spark):
    rows = [(float(x), y) for x, y in itertools.product(range(10), [True, False])]
    df = spark.createDataFrame(rows, "x double, y boolean")
    assert abs(st.mutual_information(df, ["x"], "y", bins=10).first().mi) < 1e-12


def test_percent_text_equals_python_formatting(spark):
    rng = random.Random(1)
    vals = [rng.random() for _ in range(3000)] + [k / 1000 + 0.00025 for k in range(0, 1000, 7)]
    vals += [0.1225, 0.1235, 0.0625, 0.0005, 0.9995, 1.0, 0.0, 0.5, 0.75]
    df = spark.createDataFrame([(v,) for v in vals], "c double")
    got = [r.p for r in df.select(percent_text("c").alias("p")).collect()]
    assert got == [f"{v:.1%}" for v in vals]


def test_exact_quantiles_match_numpy_with_ties_and_tiny_groups(spark):
    import numpy as np
    rng = random.Random(2)
    rows = [("big", float(rng.randint(0, 300))) for _ in range(5000)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 4.0)] + [("mid", rng.random()) for _ in range(37)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for bound in (None, 10_000):  # bucketed selection, and the checked in-memory path
        out = st.exact_quantiles(df, ["g"], "v", probs, buckets=16, max_in_memory_distinct=bound).collect()
        got = {r.g: [r[f"q{i}"] for i in range(5)] for r in out}
        for g in ("big", "one", "two", "mid"):
            vals = np.array([v for k, v in rows if k == g])
            want = np.quantile(vals, probs, method="linear")
            assert np.allclose(got[g], want, rtol=1e-12, atol=1e-12), (g, got[g], want)


def test_correlation_is_pairwise_complete_in_one_aggregate(spark):
    import random
    import numpy as np
    r = random.Random(2)
    rows = []
    for i in range(300):
        a = r.gauss(1e6, 2)
        rows.append((i % 3, a if i % 7 else None, 3 * a + r.gauss(0, 5) if i % 5 else float("nan"), r.gauss(0, 1), 4.25, 1e9 if i % 2 else None))
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, same double, half double").repartition(4)
    cols = ["a", "b", "c", "same", "half"]
    for by in ([], ["g"]):
        for r_ in st.correlation_matrix(df, cols, by=by).collect():
            part = [x[1:] for x in rows if not by or x[0] == r_["g"]]
            i, j = cols.index(r_["var_a"]), cols.index(r_["var_b"])
            xy = np.array([(x[i], x[j]) for x in part if x[i] is not None and x[j] is not None and x[i] == x[i] and x[j] == x[j]])
            if xy.std(axis=0).min() == 0:
                assert r_["corr"] is None
            else:
                assert abs(r_["corr"] - np.corrcoef(xy.T)[0, 1]) < 1e-6
    one = {(x["var_a"], x["var_b"]): x["corr"] for x in st.correlation_matrix(df, cols).collect()}
    for x in st.correlation_matrix(df, cols, absolute=True).collect():
        assert x["corr"] == (None if one[x["var_a"], x["var_b"]] is None else abs(one[x["var_a"], x["var_b"]]))
    plan = st.correlation_matrix(df, cols)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2  # one pass (shown as initial and current plan)


def test_curve_area_is_the_auc_and_thinning_keeps_its_bound(spark):
    r = random.Random(7)
    rows = [(m, r.random() < 0.3, round(r.gauss(0, 1), 2 if m == "ties" else 9)) for m in ("plain", "ties") for _ in range(4000)]
    rows = [(m, y, s + (0.8 if y else 0)) for m, y, s in rows] + [("one", True, float(i)) for i in range(9)] + [(None, i % 3 == 0, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, label boolean, score double").repartition(6)
    auc = {x["model"]: x["auc"] for x in ev.roc_auc(df, by=["model"]).collect()}
    whole = {x["model"]: x["area"] for x in ev.roc_area(ev.roc_curve(df, by=["model"]), ["model"]).collect()}
    assert auc["one"] is None and whole["one"] is None and set(auc) == {"plain", "ties", "one", None}
    for m in ("plain", "ties", None):
        pos, neg = ([s for k, y, s in rows if k == m and y == want] for want in (True, False))
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(auc[m] - want) < 1e-9 and abs(whole[m] - want) < 1e-9
    for points in (4, 20, 200):
        thin = ev.roc_curve(df, by=["model"], points=points)
        n = {x["model"]: x["count"] for x in thin.groupBy("model").count().collect()}
        area = {x["model"]: x["area"] for x in ev.roc_area(thin, ["model"]).collect()}
        for m in ("plain", "ties", None):
            assert n[m] <= points and abs(area[m] - auc[m]) <= ev.thinning_bound(points)
    assert ev.roc_curve(df.limit(0), points=20).count() == 0
