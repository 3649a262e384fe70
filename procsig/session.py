"""Spark session defaults and lineage cutting.

Cluster settings always win: every helper here reads the session first and only fills in
what is unset, and a machine-local scratch folder is only ever used for a local master.
"""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(app: str = "procsig", cores: int | str = "*", **conf: str) -> SparkSession:
    """Session for tests and the local bench. On a cluster use the cluster's own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must name a shared folder and is used as given. Only a
    local master without the setting gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if _is_local(spark):
        path = tempfile.mkdtemp(prefix="procsig-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    return None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    if ensure_checkpoint_dir(df.sparkSession) is None:
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for it")
    return df.checkpoint(eager=True)


def cut_lineage_packed(df: DataFrame, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: StructType | None = None) -> DataFrame:
    """``cut_lineage`` with the rows of a partition written as compressed columns, a block of rows each: several times
    smaller than rows. Partitions and the order inside them stay. ``then`` makes the rows of ``schema`` of a block at every read."""
    schema = schema or df.schema

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for v in b.column("rows").to_pylist():
                yield from map(then, pa.ipc.open_stream(v)) if then else pa.ipc.open_stream(v)
    written = cut_lineage(df.mapInArrow(pack, "rows binary"))
    release(df.sparkSession)
    return written.mapInArrow(unpack, schema)


def release(spark: SparkSession) -> None:
    """Shuffle files and broadcasts that nothing on the driver names any more go at once, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
