import base64
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from llm_helpers import rows_of

from procsig.llm import bpe
from procsig.llm.bpe import VOCABULARY, decode, encode, op9_byte_bpe
from procsig.sources.tables import table

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def enc():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_and_random_texts(spark, odd_docs, enc):
    rnd = random.Random(3)
    extra = ["a" * 3000, "ab" * 700 + "!" * 333, " " * 200 + "x", "\n" * 77, "=" * 64 + "-" * 65, "l'l 'll 'lx don't", "1234567890 ١٢٣"]
    extra += ["".join(rnd.choice("abcdeé 'st\n日😀.") for _ in range(rnd.randrange(1, 120))) for _ in range(150)]
    extra += ["".join(rnd.choice("ab") for _ in range(rnd.randrange(30, 90))) for _ in range(40)]
    docs = odd_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(extra, 100)), "doc_id bigint, text string")).selectExpr("*", "1 AS ids", "2 AS k")
    got = decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    want = [(r["doc_id"], enc.encode_ordinary(r["text"] or ""), bytearray((r["text"] or "").encode())) for r in docs.collect()]
    assert rows_of(got, "doc_id", "ids", "decoded") == sorted(want, key=repr)


def test_decode_of_null_and_empty(spark):
    ids = spark.createDataFrame([(1, None), (2, []), (3, [64, 65, None]), (None, [64])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in decode(ids, PATH).collect()}
    assert got[1] == got[2] == b"" and got[3][:1] == got[None]
    assert decode(ids.limit(0), PATH).count() == 0


def test_query_against_library(spark, sf, enc):
    import hashlib
    got = rows_of(op9_byte_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_long_varied_runs_within_the_memory_limit(enc):
    import regex

    from procsig.llm.bpe import Engine
    rnd = random.Random(4)
    run = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    abc = "abcdefghijklmnopqrstuvwxyz"
    texts = [run(abc, 100_000), run("acgt", 50_000), *(run(abc, 1000) for _ in range(300)), *(run(abc, 32) for _ in range(8000))]
    flat, per = Engine(PATH).encode(texts, regex.compile(public_tokenizers.PATTERN))
    want = [enc.encode_ordinary(t) for t in texts]
    assert per.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def _runs(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        m = r.randrange(1, 700)
        out.append(r.choice([
            r.choice("axeé日") * m, "".join(r.choice("abcdefgh") for _ in range(m)), "".join(r.choice("the") for _ in range(m)),
            r.choice(["abc", "tion", "ing", "anan", "er"]) * (m // 3 + 1),
            "".join(r.choice(["tion", "ing", "the", "an", "er", "sch", "é", "ß"]) for _ in range(m // 3 + 1)),
            " " * m + "-" * m + "x" * (m % 7) + "=" * m]))
    return out


@pytest.mark.parametrize("segment", [40, 97])
def test_words_over_a_segment_equal_the_library(enc, monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT_BYTES", segment)
    eng, texts = bpe.Engine(PATH), _runs(segment, 40)
    flat, per = eng.encode(texts, regex.compile(public_tokenizers.PATTERN))
    got = [x.tolist() for x in np.split(flat, np.cumsum(per)[:-1])]
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert eng.decode_texts(flat, per) == [t.encode() for t in texts]


def test_long_runs_do_not_lift_the_database_memory(enc):
    r = random.Random(5)
    eng = bpe.Engine(PATH)
    texts = ["x" * 1_000_001, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "tion" * 60_000]
    flat, per = eng.encode(texts, regex.compile(public_tokenizers.PATTERN))
    got = np.split(flat, np.cumsum(per)[:-1])
    assert (got[0][:-1] == got[0][0]).all() and eng.decode_texts(flat, per) == [t.encode() for t in texts]
    assert got[1].tolist() == enc.encode_ordinary(texts[1])
    assert eng.db.sql("SELECT current_setting('memory_limit') AS m").fetchall()[0][0].startswith("286")  # 300 MB in MiB


def test_sorted_steps_give_the_same_ids(enc, monkeypatch):
    """An engine that reports rows out of order falls back to sorted windows."""
    words = ["ingly", "zqxj", "Überraschung", "antidisestablish", "a"] + [w for t in _runs(3, 10) for w in [t[:30]]]
    monkeypatch.setattr(bpe, "_STEP", "SELECT error('rows out of order')")
    eng = bpe.Engine(PATH)
    flat, per = eng.encode(words, regex.compile(public_tokenizers.PATTERN))
    assert [x.tolist() for x in np.split(flat, np.cumsum(per)[:-1])] == [enc.encode_ordinary(t) for t in words]


def test_cache_and_blocks_are_bounded(enc, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 5)
    texts = [None, "", *(f"piece{i} and {i * 7919} more words here, é日 {'y' * i}" for i in range(30)), "one two " * 40]
    eng = bpe.Engine(PATH)
    flat, per = eng.encode(texts, regex.compile(public_tokenizers.PATTERN))
    assert [x.tolist() for x in np.split(flat, np.cumsum(per)[:-1])] == [enc.encode_ordinary(t or "") for t in texts]
    assert eng.decode_texts(flat, per) == [(t or "").encode() for t in texts]
