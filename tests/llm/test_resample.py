import math
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD_TEXTS, against_sql, rows_of
from pyspark.sql import functions as F

from procsig.llm import bytewords, crc
from procsig.llm.resample import _sql, drawn_documents, exact_ranks, feature_buckets, op12_importance_resampling, resample


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[k:k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


@pytest.mark.parametrize("segment", [8, 64, 1 << 21])
def test_buckets_of_segments(segment, monkeypatch):
    monkeypatch.setattr(bytewords.words, "__defaults__", (bytewords.ALNUM, segment))
    texts = [*ODD_TEXTS, "q" * 70 + " " + "r" * 64 + " " + "s" * 65 + " " + "t" * 3000, *(f"pqr{i} stu-{i * i}" for i in range(200))]
    got, n = [[] for _ in texts], [0] * len(texts)
    for of, bucket, per_word in feature_buckets(pa.array(texts, pa.string())):
        for i, b in zip(of.tolist(), bucket.tolist()):
            got[i].append(b)
        for i in per_word.tolist():
            n[i] += 1
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(plain_buckets(t)) and n[i] == len(plain_words(t))


def test_checksums_of_long_ranges():
    data = np.frombuffer(bytes(range(1, 251)) * 400, dtype=np.uint8)
    start, size = np.array([0, 5, 100, 0, 7]), np.array([1, 64, 65, 100_000, 70_000])
    got = crc.raw(data, start, size) ^ crc.start_value(size)
    assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, size)]


def brute(rows, target, pct=5):
    s, t = [0] * 10000, [0] * 10000
    for _, x in rows:
        for b in plain_buckets(x):
            s[b] += 1
    for x in target:
        for b in plain_buckets(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in plain_buckets(x))
        out.append([i, len(plain_buckets(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))])
    best = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(best[:pct * len(best) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def test_odd_rows_against_brute_force(spark, odd_docs):
    long = [(i if i % 5 else None, " ".join(f"w{(i * k) % 37} the" for k in range(1, 15)), "en", "s", 1, i) for i in range(40)]
    docs = odd_docs.unionByName(spark.createDataFrame(long + long[:9], odd_docs.schema))
    target = spark.createDataFrame([("the w3 the w5",), (None,), ("",), ("x" * 5000,)], "text string")
    got = rows_of(resample(docs, target, share_pct=40, segment_rows=7, samples=16), "doc_id", "n_features", "weight", "score", "rank")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], 40)
    assert got == want


@pytest.mark.parametrize("segment_rows", [3, 10, 1000])
def test_ranks_with_ties_and_one_hot_key(spark, segment_rows):
    rows = spark.range(0, 300, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50).cast("bigint").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(9))).cast("bigint").alias("score"))
    got = exact_ranks(rows, 170, F.lit(True), segment_rows, 64).collect()
    order = sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 171)) and len(got) == 300
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == order[:170]


def test_empty_tables_and_drawn_rows(spark, odd_docs):
    target = spark.createDataFrame([], "text string")
    assert resample(odd_docs.limit(0), target).count() == 0
    assert resample(odd_docs, target).where("rank IS NOT NULL").count() == 0
    docs = spark.createDataFrame([(i, f"common words {i} " * 10, "e") for i in range(100)], "doc_id bigint, text string, rank string")
    drawn = drawn_documents(docs, spark.createDataFrame([("common words 7",)], "text string"))
    assert drawn.columns == docs.columns and drawn.count() == 5


def test_sql(spark, duck, sf):
    against_sql(spark, duck, sf, op12_importance_resampling, _sql())
