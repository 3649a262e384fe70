import base64
import hashlib
import os
import re
import shutil

import public_tokenizers
import pytest
import tiktoken
from llm_helpers import ODD_TEXTS

import corpus_pipeline
from procsig.llm.quality import STOP_WORDS
from procsig.llm.secrets import MASK
from test_decontam import brute as contamination
from test_dedup import brute as duplicates
from test_quality import brute as metrics


@pytest.fixture()
def folder(spark, sf, tmp_path):
    """The smallest tables, with odd rows and an extra column of a clashing name."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id AS row_of")
    odd = spark.createDataFrame([(10 ** 6 + i if i % 3 else None, t, None, None, None, i) for i, t in enumerate(ODD_TEXTS)], docs.schema)
    docs.unionByName(odd).unionByName(docs.where("doc_id < 3")).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{sf}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def kept_by_quality(text):
    n, chars, symbols, dup, repeat = metrics(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = sum(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) in STOP_WORDS
                for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    return 1.5 <= chars / n <= 20 and symbols / n <= .5 and dup / len(lines) <= .5 and stops / n >= .01


def test_run_against_brute_force(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [d for d in docs if kept_by_quality(d[1] or "")]
    kept = {d for d, _, c, k in duplicates(docs) if d == c}
    docs = sorted({d for d in docs if d[0] in kept})  # repeated rows are copies
    docs = [d for d in docs if contamination(d[1], bench)[1] == 0]
    secret = re.compile(r"(?i)(?<=token = \")[0-9a-f]{40}(?=\")")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs:
        t = secret.sub(MASK, t)
        want[i] = (enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in got} == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert os.path.isdir(folder)
