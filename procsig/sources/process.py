"""The reference's own data model: wide process samples (one row per fault, run and sample).

Columns: ``faultNumber`` (0 = normal), ``simulationRun`` (series id), ``sample`` (time step),
41 measured variables ``xmeas_1..41`` and 11 manipulated variables ``xmv_1..11``. This module
gives the explicit schema, the ingest rules (casts, NaN -> NULL, labels, splits) and the
SeriesSpec, so every operator of the package applies to such files directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsig.operators.prepare import nan_to_null
from procsig.spec import SeriesSpec

# Variable names and counts of the process data set.
MEASURED = [f"xmeas_{i}" for i in range(1, 42)]
MANIPULATED = [f"xmv_{i}" for i in range(1, 12)]
VARIABLES = MEASURED + MANIPULATED
KEYS = ["faultNumber", "simulationRun", "sample"]

# Labels start strictly after these samples; runs up to this id train.
ONSET = {"training": 20, "testing": 160}
TRAIN_MAX_RUN = 40

SCHEMA = T.StructType(
    [T.StructField("faultNumber", T.DoubleType()), T.StructField("simulationRun", T.DoubleType()),
     T.StructField("sample", T.DoubleType())]
    + [T.StructField(v, T.DoubleType()) for v in VARIABLES])

# Faults stay part of the series key so windows never cross faults that share a run id.
SPEC = SeriesSpec(("faultNumber", "simulationRun"), ("sample",))


def ingest(df: DataFrame, split: str | Column | None = None) -> DataFrame:
    """Cast keys to int (files store them as floats), NaN -> NULL, add ``split`` if given."""
    out = nan_to_null(df).select(
        *[F.col(k).cast("int").alias(k) for k in KEYS], *[F.col(v).cast("double").alias(v) for v in VARIABLES],
        *[F.col(c) for c in df.columns if c not in KEYS and c not in VARIABLES])
    if split is not None:
        out = out.select("*", (F.lit(split) if isinstance(split, str) else split).alias("split"))
    return out


def label(df: DataFrame, split_col: str = "split") -> DataFrame:
    """faulty = faultNumber > 0 AND sample > onset of the split (strict)."""
    onset = F.when(F.col(split_col) == "training", F.lit(ONSET["training"])).otherwise(F.lit(ONSET["testing"]))
    return df.select("*", ((F.col("faultNumber") > 0) & (F.col("sample") > onset)).alias("faulty"))


def run_split(df: DataFrame, max_train_run: int = TRAIN_MAX_RUN) -> DataFrame:
    """Whole runs up to ``max_train_run`` train, the rest validation."""
    return df.select("*", F.when(F.col("simulationRun") <= max_train_run, "train").otherwise("validation")
                     .alias("holdout"))
