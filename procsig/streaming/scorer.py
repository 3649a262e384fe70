"""Streaming form of the serving chain, z-score scoring and the alert text.

``transformWithStateInPandas`` keeps per group of series (by a hash of the series key) a map state of waiting
rows by time bucket and a value state with the last two samples of every series; a state call costs a round trip,
so its number follows the groups and not the series. Rows may come in any order and in any number of files as
long as they are not older than the watermark. Each bucket has an event-time timer at its end: once the watermark
has passed it, the bucket's rows are sorted by series and time, scored in order (lags, rolling statistics, first
difference: the batch serving chain) and leave the state. So rows are emitted as the watermark moves, a call
reads one bucket of a group, and the state is the rows inside the watermark and a bucket. A row older than the
watermark on arrival is late and dropped, as Structured Streaming does.

With ``idle`` the state of a series ends that long after its last bucket: its next row starts a new
series. Without it the two samples stay. Rows without a time or a series are in no series.

The result has the attribution and text columns of the batch record: ``important_features``, tier,
context, template and cache key, as projections behind the stateful step.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from typing import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from procsig.operators.detect import Moments
from procsig.operators.explain import top_bases_expr
from procsig.operators.features import diff_name, feature_names, lag_name, rolling_name
from procsig.operators.report import with_alert_text
from procsig.session import ensure_checkpoint_dir
from procsig.sources.io import scratch_path
from procsig.spec import SeriesSpec

EVENTS_SPEC = SeriesSpec(("user_id",), ("ts", "event_id"))
#: Map states and timers need the RocksDB store; with change logs a batch writes its changes, not a snapshot.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: Rows of a replayed table per group of series, and per file of a time slice.
GROUP_ROWS, FILE_ROWS = 50_000, 250_000


def serving_matrix(seq: np.ndarray, variables: Sequence[str] = ("value",)) -> np.ndarray:
    """Features (``feature_names`` order) of every sample from the third on; ``seq``: samples x variables."""
    seq = seq.reshape(len(seq), len(variables))
    x, l1, l2 = seq[2:], seq[1:-1], seq[:-2]
    w = np.stack([l2, l1, x])
    stats = {"mean": w.mean(axis=0), "std": w.std(axis=0, ddof=1), "min": w.min(axis=0), "max": w.max(axis=0)}
    by_name = {}
    for j, v in enumerate(variables):
        by_name[v], by_name[lag_name(v, 1)], by_name[lag_name(v, 2)] = x[:, j], l1[:, j], l2[:, j]
        by_name |= {rolling_name(v, s, 3): m[:, j] for s, m in stats.items()}
        by_name[diff_name(v)] = x[:, j] - l1[:, j]
    return np.stack([by_name[n] for n in feature_names(variables)], axis=1)


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    """The rows of packed tables, one behind the other."""
    source, parts = pa.BufferReader(blob), []
    while source.tell() < source.size():
        parts.append(pa.ipc.open_stream(source).read_all())
    return pa.concat_tables(parts, promote_options="permissive")


class SeriesScorer(StatefulProcessor):
    """Waiting rows of a group of series by time bucket, emitted in order when the bucket's timer fires."""

    def __init__(self, spec: SeriesSpec, variables: Sequence[str], scaler: Moments, zmodel: Moments, threshold: float,
                 bucket_ms: int, idle_ms: int | None):
        names = feature_names(variables)
        self.key, (self.time, self.row_id) = spec.keys[0], spec.order
        self.variables, self.threshold, self.bucket_ms, self.idle_ms = list(variables), threshold, bucket_ms, idle_ms
        self.scaler = [np.array([m[f] for f in names]) for m in (scaler.mean, scaler.std)]
        self.model = [np.array([m[f] for f in names]) for m in (zmodel.mean, zmodel.std)]
        self.base = [[i for i, f in enumerate(names) if f == v or f.startswith(v + "_")] for v in self.variables]
        self.row = ["key", "ts", "id", *(f"x{j}" for j in range(len(self.variables)))]  # ts in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint", "rows binary")
        self.tail = handle.getValueState("tail", "samples binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        fresh: dict[int, list[bytes]] = {}
        for pdf in rows:
            ts = pdf[self.time].to_numpy("datetime64[us]").astype(np.int64)
            ids = np.empty(len(pdf), dtype=np.int64)
            ids[:] = pdf[self.row_id].to_numpy()
            new = pa.table([pa.array(pdf[self.key], from_pandas=True), pa.array(ts), pa.array(ids),
                            *(pa.array(pdf[v].to_numpy(dtype=float)) for v in self.variables)], names=self.row)
            bucket = ts // (self.bucket_ms * 1000)
            for b in np.unique(bucket).tolist():
                if (b + 1) * self.bucket_ms > mark:  # otherwise its rows have left
                    fresh.setdefault(b, []).append(_packed(new.filter(pa.array(bucket == b))))
        for b, parts in fresh.items():
            held = self.waiting.getValue((b,))
            self.waiting.updateValue((b,), (b"".join([bytes(held[0]), *parts] if held else parts),))
            self.handle.registerTimer((b + 1) * self.bucket_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()  # timers fire in the order of their times
        b = end // self.bucket_ms - 1
        held = self.waiting.getValue((b,)) if end % self.bucket_ms == 0 else None
        kept = self.tail.get()
        tail = before = _unpacked(bytes(kept[0])) if kept else None
        if self.idle_ms is not None and tail is not None:
            tail = self.not_idle(tail, end)
        if held:
            rows = _unpacked(bytes(held[0]))
            self.waiting.removeKey((b,))
            if self.idle_ms is not None:
                self.handle.registerTimer(end + self.idle_ms)
            if tail is None:
                tail = rows.slice(0, 0).append_column("until", pa.array([], pa.int64()))
            goes_on = pc.is_in(tail["key"], value_set=rows["key"].combine_chunks())
            old, others = tail.filter(goes_on), tail.filter(pc.invert(goes_on))
            out, last = self.scored(old.select(self.row), rows)
            last = last.append_column("until", pa.array(np.full(len(last), end)))
            tail = pa.concat_tables([others, last], promote_options="permissive")
            if len(out):
                yield out
        if tail is not None and len(tail) == 0:
            self.tail.clear()
        elif tail is not before:
            self.tail.update((_packed(tail),))

    def not_idle(self, tail: pa.Table, end: int) -> pa.Table:
        """``tail`` without the series whose idle time ends now and that have no waiting rows."""
        due = pc.equal(tail["until"], end - self.idle_ms)
        if not pc.any(due).as_py():
            return tail
        for held in self.waiting.values():
            due = pc.and_(due, pc.invert(pc.is_in(tail["key"], value_set=_unpacked(bytes(held[0]))["key"].combine_chunks())))
        return tail.filter(pc.invert(due))

    def scored(self, old: pa.Table, rows: pa.Table) -> tuple[pd.DataFrame, pa.Table]:
        """(the scored ones among ``rows``, the last two samples of every series); ``old``: the last two before them."""
        t = pa.concat_tables([old, rows], promote_options="permissive").combine_chunks()
        code = t["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        x = np.stack([t[c].to_numpy() for c in self.row[3:]], axis=1)
        order = np.lexsort((*x.T[::-1], t["id"].to_numpy(), t["ts"].to_numpy(), code))
        code, x = code[order], x[order]
        place = np.arange(len(code)) - np.searchsorted(code, code)
        behind = np.searchsorted(code, code, side="right") - np.arange(len(code)) - 1
        pick = np.flatnonzero((place >= 2) & (order >= len(old)))
        x = serving_matrix(x, self.variables)[pick - 2]
        full = ~np.isnan(x).any(axis=1)
        z = np.abs(((x[full] - self.scaler[0]) / self.scaler[1] - self.model[0]) / self.model[1])
        most = z.max(axis=1) if len(z) else np.empty(0)
        of = t.take(pa.array(order[pick][full]))
        out = {self.key: of["key"].to_pandas(), self.time: of["ts"].to_numpy().astype("datetime64[us]"), self.row_id: of["id"].to_numpy(),
               "max_z": most, "prediction": (most > self.threshold).astype(np.int32), "confidence": 1 / (1 + np.exp(self.threshold - most))}
        out |= {f"{v}__total": (z[:, cols] - self.threshold).sum(axis=1) for v, cols in zip(self.variables, self.base)}
        return pd.DataFrame(out), t.take(pa.array(order[behind < 2]))

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """The settings of the state store while a query starts."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def state_groups(spark: SparkSession, rows: int = 0) -> int:
    """Groups of series in the state: four for every shuffle partition, more for many rows."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // GROUP_ROWS))


def score_stream(events: DataFrame, scaler: Moments, zmodel: Moments, threshold: float, watermark: str = "1 day",
                 idle_days: int | None = None, spec: SeriesSpec = EVENTS_SPEC, variables: Sequence[str] = ("value",),
                 bucket: str = "1 hour", descriptions: Mapping[str, str] | None = None, top_n: int = 3,
                 groups: int | None = None) -> DataFrame:
    """Streaming DataFrame of scored rows with their alert texts (append mode), each once the watermark has
    passed its ``bucket``. The state is kept in ``groups`` of series, by default four for every shuffle partition.
    The query must start inside ``state_store(spark)``."""
    bucket_ms = int(pd.Timedelta(bucket).total_seconds() * 1000)
    processor = SeriesScorer(spec, variables, scaler, zmodel, threshold, bucket_ms, None if idle_days is None else idle_days * 86_400_000)
    key, (time, row_id) = spec.keys[0], spec.order
    schema = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField(time, T.TimestampType()),
                           T.StructField(row_id, T.LongType()), T.StructField("max_z", T.DoubleType()),
                           T.StructField("prediction", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
                           *[T.StructField(f"{v}__total", T.DoubleType()) for v in variables]])
    # watermarks need TIMESTAMP (with time zone)
    timed = events.select(key, F.col(time).cast("timestamp").alias(time), row_id, *variables).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    groups = groups or state_groups(events.sparkSession)
    scored = (timed.withColumn("series_group", F.pmod(F.xxhash64(key), F.lit(groups)))
              .withWatermark(time, watermark).groupBy("series_group")
              .transformWithStateInPandas(processor, schema, "Append", "EventTime"))
    top = top_bases_expr({v: f"{v}__total" for v in variables}, top_n, descriptions)
    return with_alert_text(scored.select(key, time, row_id, "max_z", "prediction", "confidence", top.alias("important_features")))


def closing_row(events: DataFrame, key_value: int = -1, days: int = 3650, spec: SeriesSpec = EVENTS_SPEC) -> DataFrame:
    """One row of a series of its own, far behind the last event: it moves the watermark past all others."""
    key, (time, _) = spec.keys[0], spec.order
    end = events.agg(F.max(time).alias("end")).where("end IS NOT NULL")
    fill = {key: F.lit(key_value), time: F.col("end") + F.expr(f"INTERVAL '{days}' DAY"), spec.order[1]: F.lit(-1)}
    return end.select(*[(fill.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in events.schema.fields])


def run_to_table(spark: SparkSession, events: DataFrame, scaler: Moments, zmodel: Moments, threshold: float,
                 files: int = 4, watermark: str | None = None, spec: SeriesSpec = EVENTS_SPEC, variables: Sequence[str] = ("value",),
                 descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """Replay ``events`` through the stream, one time slice per trigger, until every row is scored, into a table
    under the shared checkpoint folder; returns that table.

    The events are cut into ``files`` time slices; by a hash of its id a row comes with its own slice or
    with the next, so every slice's files mix rows of two slices in no order; a slice has one file for every
    ``FILE_ROWS`` rows. The watermark is by default two slices and a second, which no row is later than, also if a
    trigger takes files of two slices; the state holds at most four slices. A closing row ends the stream.
    """
    ensure_checkpoint_dir(spark)
    run = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    key, (time, row_id) = spec.keys[0], spec.order
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, row_id, *variables)
    source = f"{run}/in"
    ends = rows.select(F.unix_micros(F.col(time).cast("timestamp")).alias("t")).agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, 0)
    length = max((hi - lo) // files + 1, 1)
    per_slice = max(1, -(-ends["n"] // (files * FILE_ROWS)))
    slice_ = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.lit(lo)) / F.lit(length)) + F.pmod(F.xxhash64(row_id), F.lit(2))
    staged = f"{run}/staged"
    rows.withColumn("slice", slice_.cast("int")).write.partitionBy("slice").parquet(staged)
    sliced = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(staged)
    for i in range(files + 1):  # in turn: the stream takes files by their age
        sliced.where(F.col("slice") == i).drop("slice").repartition(per_slice).write.mode("append").parquet(source)
    closing_row(rows, days=max(36_500, length // 86_400_000_000 * 4 + 2), spec=spec).coalesce(1).write.mode("append").parquet(source)
    watermark = watermark or f"{2 * length // 1_000_000 + 2} seconds"
    bucket = f"{length // 1_000_000 + 1} seconds"
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_slice).parquet(source)
    with state_store(spark):
        scored = score_stream(src, scaler, zmodel, threshold, watermark, spec=spec, variables=variables, bucket=bucket, descriptions=descriptions,
                              groups=state_groups(spark, ends["n"]))
        q = (scored.writeStream.format("parquet").option("checkpointLocation", f"{run}/_checkpoint")
             .option("path", f"{run}/out").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{run}/out")
