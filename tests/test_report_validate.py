from pyspark.sql import functions as F

from procsig.operators import explain as ex
from procsig.operators import report as rp
from procsig.operators import validate as va
from procsig.operators.features import feature_catalog


def test_signed_totals_rank_negative_last_and_unknown_bases(spark):
    contrib = spark.createDataFrame([(1, "a", 2.0), (1, "a_lag_1", 1.0), (1, "b", -5.0), (1, "c", 0.5)],
                                    "row int, feature string, contribution double")
    cat = feature_catalog(spark, ["a", "b", "c"], lags=(1,))
    tot = ex.attribution_by_base(contrib, cat, ["row"])
    dim = spark.createDataFrame([("a", "A text"), ("b", "B text")], "base string, description string")
    top = ex.top_variables(tot, ["row"], 3, dim).orderBy("rank").collect()
    assert [r.base for r in top] == ["a", "c", "b"] and top[0].total == 3.0 and top[1].description is None
    assert [r.base for r in ex.unknown_bases(tot, dim).collect()] == ["c"]
    fmt = ex.format_attribution(ex.top_variables(tot, ["row"], 2, dim), ["row"]).first().important_features
    assert [x.variable_name for x in fmt] == ["a", "c"]


def test_row_wise_top_bases(spark):
    df = spark.createDataFrame([(1.0, -2.0, 1.0)], "a double, b double, c double")
    top = df.select(ex.top_bases_expr({"a": "a", "b": "b", "c": "c"}, 2, {"a": "A"}).alias("t")).first().t
    assert [(x.variable_name, x.description, x.importance_score) for x in top] == [("a", "A", 1.0), ("c", None, 1.0)]


def test_invalid_response_falls_back_and_worklist_dedups(spark):
    full = "STATUS: x\nISSUE: y\nROOT CAUSE: z\nIMMEDIATE ACTION: do it \nMONITORING: m"
    analyses = spark.createDataFrame([("k1", 1, "T1"), ("k1", 2, "T1"), ("k2", 3, "T2"), ("k3", 4, "T3")],
                                     "cache_key string, seq int, template string")
    responses = spark.createDataFrame([("k1", full), ("k2", "STATUS: only")], "cache_key string, response string")
    res = {r.seq: r for r in rp.resolve_explanation(analyses, responses).collect()}
    assert res[1].explanation == full.strip() and res[1].action == "do it" and res[1].from_cache
    assert res[3].explanation == "T2" and not res[3].from_cache and res[3].action == "Monitor process parameters"
    wl = {r.cache_key: (r.seq, r.n_requests) for r in rp.worklist(analyses, responses, "seq").collect()}
    assert wl == {"k2": (3, 1), "k3": (4, 1)}
    wl_all = {r.cache_key: (r.seq, r.n_requests) for r in rp.worklist(analyses, None, "seq").collect()}
    assert wl_all["k1"] == (1, 2)


def test_history_window_bounded(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(1, 6)], "s int, seq int, tier string")
    out = {r.seq: [h.tier for h in r.history] for r in rp.history_window(df, ["s"], "seq", F.struct("tier"), 3).collect()}
    assert out[1] == [] and out[5] == ["t2", "t3", "t4"]


def test_validation_reports(spark):
    ok = [("f1", r, s, 1.0) for r, s in ((1, 1), (1, 2), (1, 3))]
    two_rows = [("f2", 1, 1, 1.0), ("f2", 1, 2, 1.0)]
    multi = [("f3", 1, 2, 1.0), ("f3", 2, 1, 1.0), ("f3", None, 3, 1.0)]
    df = spark.createDataFrame(ok + two_rows + multi, "src string, run int, sample int, x double")
    df = df.select("*", F.monotonically_increasing_id().alias("seq"))
    out = {r.src: r for r in va.validate(df, "src", "run", "sample", ["x", "y"], ["seq"]).collect()}
    assert out["f2"].errors == ["Need at least 3 rows, got 2"] and not out["f2"].is_valid
    assert "Missing feature columns: y" in out["f1"].errors
    assert any(e.startswith("NULL values in key columns") for e in out["f3"].errors)
    assert "Samples are not in ascending order" in out["f3"].warnings
    assert any(w.startswith("Multiple runs found") for w in out["f3"].warnings)
    text = spark.createDataFrame([("f", 1, 1, "a"), ("f", 1, 2, "b"), ("f", 1, 3, "c")],
                                 "src string, run int, sample int, x string")
    r = va.validate(text, "src", "run", "sample", ["x"], ["sample"]).first()
    assert r.errors == ["Non-numeric feature columns: x"]


def test_wide_attribution_equals_the_long_one_without_a_shuffle(spark):
    from procsig.operators.detect import Moments
    nan = float("nan")
    df = spark.createDataFrame([(1, 2.0, 1.0, -5.0, 0.5), (2, None, 3.0, 3.0, None), (3, 1.0, nan, 4.0, 9.0), (4, None, None, 1.0, 1.0)],
                               "row int, a double, a_lag_1 double, b double, other double")
    m = Moments({f: 0.5 for f in df.columns[1:]}, {f: 2.0 for f in df.columns[1:]})
    cat, dim = feature_catalog(spark, ["a", "b"], lags=(1,)), spark.createDataFrame([("a", "A text")], "base string, description string")
    out = []
    for wide in (False, True):
        tot = ex.attribution_by_base(ex.zscore_contributions(df, m, 1.0, ["row"], wide=wide), cat, ["row"])
        fmt = ex.format_attribution(ex.top_variables(tot, ["row"], 2, dim), ["row"])
        out.append((sorted(map(str, (ex.long_totals(tot, ["row"]) if wide else tot).collect())), sorted(map(str, fmt.collect()))))
    assert out[0] == out[1]
    assert "Exchange" not in fmt._jdf.queryExecution().executedPlan().toString()


def test_the_bound_of_the_training_series_is_read_from_the_table(spark, tmp_path, monkeypatch):
    from procsig.plans import analysis, bound
    rows = [(i // 20, f"1995-01-{i % 20 + 1:02d}", i, 1, float(i % 7), float(i % 11), 0.1 * (i % 3), 0.01 * (i % 5), "R" if i % 6 == 0 else "N", "F")
            for i in range(200)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate string, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string") \
        .selectExpr("* EXCEPT (l_shipdate)", "cast(l_shipdate AS timestamp_ntz) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    cuts, split = [], analysis.holdout_split
    monkeypatch.setattr(analysis, "holdout_split", lambda *a, cut=None, **k: (cuts.append(cut), split(*a, cut=cut, **k))[1])
    rec = bound.lineitem_records(spark, str(tmp_path), chunks=2)
    assert len(cuts) == 1 and abs(cuts[0] - 7.2) < 1e-9
    assert {(r["l_suppkey"], r["split"]) for r in rec.collect()} == {(k, "train" if k < 8 else "validation") for k in range(10)}
