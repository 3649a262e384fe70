import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from procsig.operators import features as fe
from procsig.operators.detect import Moments, zscore_score
from procsig.operators.features import feature_names
from procsig.sources.io import scratch_path
from procsig.spec import SeriesSpec
from procsig.streaming import scorer
from procsig.streaming.scorer import EVENTS_SPEC, SeriesScorer, run_to_table, score_stream, serving_matrix, state_store

NAMES = feature_names(["value"])
UNIT = Moments({f: 0.0 for f in NAMES}, {f: 1.0 for f in NAMES})
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"
T0 = dt.datetime(2024, 1, 1)


def _batch(df):
    feats = fe.feature_chain_serving(df, SeriesSpec(("user_id",), ("ts", "event_id")), ["value"])
    scored = zscore_score(feats, UNIT, 3.0)
    return {(r["user_id"], r["event_id"]): r["max_z"] for r in scored.collect()}


def test_files_in_any_order_equal_the_batch_chain(spark):
    rnd = random.Random(6)
    rows = [(i, T0 + dt.timedelta(minutes=rnd.randrange(900)), rnd.choice([1, 1, 1, 2, 3]), float(rnd.randrange(9))) for i in range(120)]
    rows += [(900, T0, 7, 1.0), (901, T0 + dt.timedelta(days=30), 8, 1.0), (902, T0, None, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for files in (1, 2, 5):
        got = {(r["user_id"], r["event_id"]): r["max_z"] for r in run_to_table(spark, df, UNIT, UNIT, 3.0, files=files).collect()}
        want = _batch(df.where("user_id IS NOT NULL"))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rows_older_than_the_watermark_are_late(spark):
    folder = scratch_path(spark, "late-test")
    batches = [[(i, T0 + dt.timedelta(minutes=i), 1, float(i % 5)) for i in range(6)],
               [(50, T0 + dt.timedelta(days=2), 2, 0.0)],               # moves the watermark by two days less one hour
               [(100, T0 + dt.timedelta(minutes=2), 1, 99.0)],          # late
               [(51, T0 + dt.timedelta(days=9), 2, 0.0)]]
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with state_store(spark):
        q = (score_stream(src, UNIT, UNIT, 3.0, "1 hour", idle_days=1).writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(r["event_id"] for r in out.collect()) == [2, 3, 4, 5]
    assert out.where(F.col("tier").isNull()).count() == 0


def test_serving_matrix_is_the_feature_chain():
    x = np.array([4.0, 0.0, 1.0])
    got = serving_matrix(x)[0]
    assert np.allclose(got, [1, 0, 4, x.mean(), x.std(ddof=1), 0, 4, 1])


def test_events_over_more_than_ten_years_are_all_scored(spark):
    rows = [(i, T0 + dt.timedelta(days=i * 150), i % 2, float(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["user_id"], r["event_id"]): r["max_z"] for r in run_to_table(spark, df, UNIT, UNIT, 3.0).collect()}
    want = _batch(df)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


class _State:
    """A state handle in memory that counts its calls."""

    def __init__(self):
        self.calls, self.timers, self.map, self.value = 0, set(), {}, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return _Value(self)

    def registerTimer(self, at):
        self.calls, _ = self.calls + 1, self.timers.add(at)

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls, self.map[key] = self.calls + 1, value

    def removeKey(self, key):
        self.calls, _ = self.calls + 1, self.map.pop(key)

    def values(self):
        self.calls += 1
        return iter(self.map.values())


class _Value:
    def __init__(self, state):
        self.state = state

    def get(self):
        self.state.calls += 1
        return self.state.value

    def update(self, value):
        self.state.calls, self.state.value = self.state.calls + 1, value

    def clear(self):
        self.state.calls, self.state.value = self.state.calls + 1, None


class _At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def _scores(state, rows, idle_ms=None):
    """event ids and max_z of ``(event_id, minute, user, value)`` in batches, after each of which all timers up to its last row fire."""
    s = SeriesScorer(EVENTS_SPEC, ["value"], UNIT, UNIT, 3.0, 600_000, idle_ms)
    s.init(state)
    got, mark = {}, 0
    for batch in rows:
        pdf = pd.DataFrame(batch, columns=["event_id", "ts", "user_id", "value"])
        end = int(pdf["ts"].max() * 60_000)
        pdf["ts"] = pd.to_datetime(pdf["ts"], unit="m").astype("datetime64[us]")
        list(s.handleInputRows((0,), iter([pdf[:len(pdf) // 2], pdf[len(pdf) // 2:]]), _At(mark)))
        mark = end
        while min(state.timers, default=mark + 1) <= mark:
            at = min(state.timers)
            state.timers.remove(at)
            for out in s.handleExpiredTimer((0,), _At(mark), _At(at)):
                got |= dict(zip(out["event_id"], out["max_z"]))
    return got


def test_state_calls_do_not_grow_with_the_series():
    rnd, calls = random.Random(4), []
    for users in (3, 300):
        rows = [[(k * 10_000 + 10 * u + j, 10 * k + j, u, float(rnd.randrange(9))) for u in range(users) for j in range(2 + u % 3)] for k in range(4)]
        for part in rows:
            rnd.shuffle(part)
        end = [(99_999, 10_000, -1, 0.0)]
        state = _State()
        got = _scores(state, [*rows, end])
        calls.append(state.calls)
        flat, want = sorted((u, m, i, v) for part in rows for i, m, u, v in part), {}
        for u in range(users):
            mine = [r for r in flat if r[0] == u]
            want |= dict(zip([r[2] for r in mine[2:]], np.abs(serving_matrix(np.array([r[3] for r in mine]))).max(axis=1)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert calls[0] == calls[1]


def test_a_series_ends_after_its_idle_time_and_others_of_its_group_go_on():
    rows = [[(i, i, u, 1.0) for u in (1,) for i in range(3)] + [(10 + i, i, 2, 1.0) for i in range(3)],
            [(13, 25, 2, 1.0), (30, 29, 3, 1.0)],                     # series 2 goes on within the idle time
            [(31, 75, 3, 1.0)],
            [(3, 80, 1, 1.0), (4, 81, 1, 1.0), (5, 82, 1, 1.0)],      # series 1 begins anew: 5 is its first scored row
            [(99, 10_000, -1, 0.0)]]
    assert sorted(_scores(_State(), rows, idle_ms=1_200_000)) == [2, 5, 12, 13]
    assert sorted(_scores(_State(), rows)) == [2, 3, 4, 5, 12, 13]


def test_slices_of_many_files_equal_the_batch_chain(spark, monkeypatch):
    monkeypatch.setattr(scorer, "FILE_ROWS", 20)
    monkeypatch.setattr(scorer, "GROUP_ROWS", 10)
    rnd = random.Random(8)
    rows = [(i, T0 + dt.timedelta(minutes=rnd.randrange(900)), rnd.randrange(12), float(rnd.randrange(9))) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["user_id"], r["event_id"]): r["max_z"] for r in run_to_table(spark, df, UNIT, UNIT, 3.0).collect()}
    want = _batch(df)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
