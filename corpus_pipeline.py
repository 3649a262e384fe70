"""Corpus pipeline: quality rules, near-dedup, decontamination, secret scan, byte-level BPE.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which ``run`` writes as Parquet and rereads as the next stage's ``docs``. All but the last
return the columns of their input. Defined results for odd input are those of the operators; extra
columns pass through every stage but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.bpe import VOCABULARY, encode_decode
from procsig.llm.decontam import decontaminate
from procsig.llm.dedup import drop_near_duplicates
from procsig.llm.quality import keep_good
from procsig.llm.secrets import redact
from procsig.session import ensure_checkpoint_dir
from procsig.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_duplicates(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    import public_tokenizers
    return encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("byte_bpe", tokens_stage),
]

#: The grouping, forest and tokenizer stages have no SQL form; a test holds ``run`` against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is a Parquet table in the shared folder."""
    base = ensure_checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for it")
    out = f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
