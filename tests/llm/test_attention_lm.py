import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import rows_of
from pyspark.sql import functions as F

from procsig.llm import attention_lm as lm
from procsig.llm.attention_lm import Attention, class_scores, lm_scores, op3_lm_scores

PATH, PATTERN = public_tokenizers.path(lm.VOCABULARY), public_tokenizers.PATTERN


def brute(rows):
    """Base columns of the contract, word by word."""
    toks = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    c = {}
    for t, h in zip(toks, held):
        for w in t if not h else []:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    return [(rows[k][0], held[k], len(t), sum(c.get(w, 0) > 0 for w in t), n,
             round(sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in t), 6)) for k, t in enumerate(toks)]


@pytest.mark.parametrize("frequent", [262_144, 3])
def test_base_columns(spark, odd_docs, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    got = lm_scores(odd_docs.selectExpr("*", "1 AS h", "2 AS row_id", "3 AS rare"), PATH, PATTERN, steps=5)
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    cols = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert rows_of(got.withColumn("b", F.round("base_score", 6)), *cols, "b") == sorted(want, key=repr)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.collect())
    assert lm_scores(odd_docs.limit(0), PATH, PATTERN, steps=5).count() == 0
    only = lm_scores(odd_docs.where("doc_id IS NULL").withColumn("doc_id", F.lit(5).cast("bigint")), PATH, PATTERN, steps=2)
    assert {r["train_tokens"] for r in only.collect()} <= {0, sum(x[2] for x in brute(
        [(5, r["text"]) for r in odd_docs.where("doc_id IS NULL").collect()]))}


def test_gradient():
    rng = np.random.default_rng(0)
    a = Attention()
    a.p["b"] = rng.normal(size=lm.WINDOW)
    c, t = rng.integers(0, lm.CLASSES, (2, 3, lm.WINDOW))
    _, g = a.loss(c, t)
    for k, x in a.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in x.shape)
            keep = x[at]
            x[at] = keep + 1e-5
            up, _ = a.loss(c, t)
            x[at] = keep - 1e-5
            down, _ = a.loss(c, t)
            x[at] = keep
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_windows_score_each_place_once_and_causally():
    rng = np.random.default_rng(1)
    a = Attention()
    t = a.tables()
    per = np.array([1, lm.WINDOW, lm.WINDOW + 1, 200, 3])
    cls = rng.integers(0, lm.CLASSES, per.sum())
    got = class_scores(cls, per, t)
    p, at = a.p, 0
    for n in per:
        x = np.r_[2, cls[at:at + n]]
        for i in range(n):  # the window that scores place i
            stride = lm.WINDOW - lm.OVERLAP
            k = 0 if i < lm.WINDOW else (i - lm.OVERLAP) // stride
            lo = k * stride
            e = p["E"][x[lo:i + 1]]
            s = e[-1] @ p["Q"] @ (e @ p["K"]).T / math.sqrt(lm.DIM) + p["b"][np.arange(len(e))[::-1]]
            w = np.exp(s - s.max())
            h = e[-1] + (w / w.sum()) @ e @ p["V"] @ p["O"]
            y = h @ p["W"] + p["a"]
            assert abs(got[at + i] - (y[x[i + 1]] - y.max() - np.log(np.exp(y - y.max()).sum()))) < 1e-3
        at += n


def test_model_beats_base_on_held_out_text(spark):
    rnd = random.Random(3)
    topics = [[f"{a}{b}" for a in s for b in ("ra", "lo", "min", "tek", "sul", "po", "var", "dun")] for s in
              (("ka", "be", "zo"), ("mi", "fu", "ty"), ("wa", "qi", "xe"))]
    rows = []
    for i in range(500):
        words = topics[i % 3]
        rows.append((i, " ".join(words[min(int(rnd.expovariate(0.15)), len(words) - 1)] for _ in range(rnd.randrange(30, 80)))))
    got = lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, PATTERN, steps=300)
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_query(spark, sf):
    got = op3_lm_scores(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs])
    cols = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert rows_of(got, *cols) == sorted((x[:5] for x in want), key=repr)
    assert max(abs(r["base_score"] - w[5]) for r, w in zip(got.orderBy("doc_id").collect(), sorted(want))) < 1e-4


def test_score_counts_every_trained_word_at_any_bound(spark, odd_docs, sf, monkeypatch):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(300))
    got = []
    for frequent in (262_144, 40, 0):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got.append(rows_of(lm_scores(docs, PATH, PATTERN, steps=5).withColumn("b", F.round("base_score", 6)),
                           "doc_id", "n_tokens", "n_known", "b", "score"))
    for other in got[1:]:
        assert [r[:4] for r in other] == [r[:4] for r in got[0]]
        assert np.allclose([r[4] for r in other], [r[4] for r in got[0]], rtol=1e-9)


def test_every_window_of_every_text_trains(spark):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, lm.CLASSES, n).astype(np.int32) for n in (700, 5, 20, 9, 900, 3)]
    _, seen = Attention().tuned(iter(parts))
    assert seen == -(-(sum(map(len, parts)) - 1) // lm.WINDOW)  # one window for every WINDOW places to predict
    texts = [" ".join(f"word{i} tail{i}" for i in range(k, k + 3000)) for k in (0, 5000)]
    sub = lm.subwords(PATH, PATTERN)
    n, _ = lm.id_places(spark.createDataFrame([(t,) for t in texts], "text string"), PATH, PATTERN)
    assert n.sum() == len(sub.spell(sub.read(texts)[0])[0])
    assert not hasattr(lm, "stretches")


def test_one_pass_gathers_counts_and_places(spark):
    texts = ["alpha beta alpha", "", None, "beta gamma", " ", "alpha beta alpha"] + [f"word{i} alpha" for i in range(40)]
    sub = lm.subwords(PATH, PATTERN)
    both = lm.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), PATH, PATTERN).collect()
    n, total = np.zeros(sub.size, np.int64), np.zeros((sub.size, lm.PLACE))
    for t in texts:
        ids = sub.spell(sub.read([t])[0])[0]
        mean = lm._signs(sub.size)[ids].mean(axis=0)
        np.add.at(n, ids, 1)
        if t:
            np.add.at(total, ids, mean / max(np.linalg.norm(mean), 1e-9))
    got = {r["id"]: (r["n"], r["v"]) for r in both if r["id"] is not None}
    assert {i: c for i, (c, _) in got.items()} == {int(i): int(n[i]) for i in np.flatnonzero(n)}
    assert all(np.allclose(v, total[i], atol=1e-5) for i, (_, v) in got.items())
    words = {r["h"]: r["n"] for r in both if r["id"] is None}
    assert words[int(lm.END)] == len(texts) and sum(words.values()) == sum(len((t or "").split()) + 1 for t in texts)


def test_a_task_sends_each_word_once_however_many_texts_it_reads(spark):
    sub = lm.subwords(PATH, PATTERN)
    tally = lm._Tally(sub)
    for _ in range(3):
        tally.add(["alpha beta", "beta gamma"])
    rows = next(tally.rows()).to_pydict()
    assert sorted(n for i, n in zip(rows["id"], rows["n"]) if i is None) == [3, 3, 6, 6]


def test_passes_use_the_work_arrays_again():
    rng = np.random.default_rng(2)
    a = Attention()
    x = rng.integers(0, lm.CLASSES, (2, 4, lm.WINDOW + 1))
    first = a.loss(x[0][:, :-1], x[0][:, 1:])
    held = {k: id(v) for k, v in a.work.items()}
    a.loss(x[1][:, :-1], x[1][:, 1:])
    again = a.loss(x[0][:, :-1], x[0][:, 1:])
    assert held and held == {k: id(v) for k, v in a.work.items()}
    assert first[0] == again[0] and all(np.array_equal(first[1][k], again[1][k]) for k in first[1])


def test_words_read_together_are_spelled_as_if_alone():
    rnd = random.Random(4)
    chars = "ab'sT 12 é中\u00a0\u2003\n\t\x1c\x85.,-\ud800\U0001f600İ"
    texts = [None, "", " ", "x" * 300, "don't 's", "A a"] + ["".join(rnd.choice(chars) for _ in range(rnd.randrange(80))) for _ in range(300)]
    sub = lm.Subwords(PATH, PATTERN)
    for lo in range(0, len(texts), 50):
        code, per_text = sub.read(texts[lo:lo + 50])
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() + [None] for t in texts[lo:lo + 50]]
        assert per_text.tolist() == [len(w) for w in words]
        flat, n = sub.spell(code)
        got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert got == [[sub.size - 1] if w is None else sub.encoding.encode_ordinary(" " + w.decode("utf-8", "surrogatepass"))
                       for t in words for w in t]


def test_words_that_come_again_are_not_spelled_again(monkeypatch):
    sub = lm.Subwords(PATH, PATTERN, limit=100)
    asked = []
    spell = lm.Subwords._encode
    monkeypatch.setattr(lm.Subwords, "_encode", lambda self, text: asked.append(text.split()) or spell(self, text))
    often = [f"often{i}" for i in range(30)]
    for k in range(8):
        text = " ".join(often * 2 + [f"once{k}x{i}" for i in range(40)])
        code, _ = sub.read([text])
        assert len(sub.codes) <= 100 + 70
        want = [i for w in text.split() for i in sub.encoding.encode_ordinary(" " + w)] + [sub.size - 1]
        assert sub.spell(code)[0].tolist() == want
    flat = [w for x in asked for w in x]
    assert len(flat) == len(set(flat)) == 30 + 8 * 40
    crowd = [f"crowd{i}" for i in range(300)]  # more than the limit, all of them often
    for _ in range(3):
        assert sub.spell(sub.read([" ".join(crowd * 2)])[0])[0][-1] == sub.size - 1
    sub.make_room()
    assert len(sub.codes) <= 51


def test_numbers_grow_and_hold_words_in_one_slot():
    numbers = lm._Numbers(slots=4)
    h = np.arange(1, 3000, dtype=np.uint64) * np.uint64(1 << 10)  # many share the low bits
    for lo in range(0, len(h), 100):
        assert (numbers.find(h[lo:lo + 100]) == -1).all()
        numbers.add(h[lo:lo + 100])
    assert (numbers.find(h) == np.arange(1, 3000)).all() and len(numbers) == 3000
    assert numbers.find(np.array([lm.END, 7], dtype=np.uint64)).tolist() == [0, -1]
    assert len(numbers.find(np.empty(0, dtype=np.uint64))) == 0


def test_gradient_by_pairs_of_classes_holds_where_places_share_a_class():
    a = Attention()
    c = np.zeros((2, lm.WINDOW), dtype=np.int64) + 5
    t = np.arange(2 * lm.WINDOW).reshape(2, lm.WINDOW) % lm.CLASSES
    _, g = a.loss(c, t)
    for k in "EQKVO":
        x = a.p[k]
        at = (5, 3) if k == "E" else (2, 3)
        keep = x[at]
        x[at] = keep + 1e-5
        up, _ = a.loss(c, t)
        x[at] = keep - 1e-5
        down, _ = a.loss(c, t)
        x[at] = keep
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6
    assert a.loss(c, t, valued=False)[0] is None


@pytest.mark.parametrize("size", [1.0, 40.0, 400.0])
def test_exponents_are_held_where_a_sum_would_leave_single_precision(size):
    rng = np.random.default_rng(6)
    w, h = (rng.normal(0, 1, s).astype(np.float32) for s in ((lm.CLASSES, 3), (3, 500)))
    w *= np.float32(size)
    got, every = lm._exponentials(w, h)
    want = np.exp(np.clip((w @ h).astype(float), -60, 60))
    assert np.isfinite(got).all() and (every > 0).all()
    assert np.allclose(every, want.sum(axis=0), rtol=1e-4)
    assert np.allclose(got / every, want / want.sum(axis=0), rtol=1e-4, atol=1e-12)
