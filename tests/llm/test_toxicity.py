import zlib

import numpy as np
import pyarrow as pa
from llm_helpers import rows_of
from pyspark.sql import functions as F

from procsig.llm import toxicity as module
from procsig.llm.bytewords import words
from procsig.llm.labelmodel import LabelModel, LinearClassifier
from procsig.llm.toxicity import PATTERNS, Entries, features, observed, telling, feature_counts, toxicity, train, training_sample

BAD = ["vilor", "grumbat", "zekkan", "dolfish", "mukravel", "sprangel"]


def corpus(n, seed=3, noise=0.0):
    """Texts with label 1 where three or more bad words stand; some clean ones hold one."""
    rng = np.random.default_rng(seed)
    common = [f"{a}{b}" for a in "mi ta ro le su ka".split() for b in "no da li res ter".split()]
    rows = []
    for i in range(n):
        w = list(rng.choice(common, rng.integers(30, 90)))
        toxic = i % 6 == 0
        for k in range(rng.integers(3, 7) if toxic else int(i % 5 == 1)):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(BAD)) + str(rng.choice(["", "", "en", "ish"])))
        rows.append((i, " ".join(w), int(toxic) if rng.random() >= noise else 1 - int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_held_out_accuracy_with_wrong_labels(spark):
    rows = corpus(1500, noise=0.06)
    docs, labels = frames(spark, rows)
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    clean = [i % 6 == 0 for i in range(len(rows))]
    out = [i for i in got if got[i]["held_out"]]
    assert out and all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in got)
    assert np.mean([got[i]["predicted"] == clean[i] for i in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_change_nothing(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    cols = ("doc_id", "held_out", "score", "predicted")
    assert rows_of(toxicity(docs, labels), *cols) == rows_of(toxicity(docs, turned), *cols)


def test_odd_rows(spark, odd_docs):
    rows = corpus(300)
    docs, labels = frames(spark, rows)
    model = train(docs, labels)
    got = toxicity(odd_docs, labels, model=model)
    assert got.count() == odd_docs.count() and got.where("score IS NULL OR isnan(score) OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert got.where("doc_id IS NULL AND NOT held_out").count() == 0
    assert toxicity(odd_docs.limit(0), labels, model=model).count() == 0


def test_missing_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity(odd_docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity(odd_docs, one).collect()} == {1.0}


def test_sample_is_bounded_and_one_text_an_id(spark):
    docs, labels = frames(spark, corpus(900))
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("a "), "text")))
    both = labels.unionByName(labels.withColumn("toxic", F.lit(1)))
    sample = training_sample(twice, both, bound=100)
    assert 60 <= sample.count() <= 140 and sample.select("doc_id").distinct().count() == sample.count()
    assert sample.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0").count() == 0
    assert rows_of(sample, "doc_id", "text", "toxic") == rows_of(training_sample(twice.repartition(3), both, bound=100), "doc_id", "text", "toxic")


def test_features_of_words(monkeypatch):
    text = "Abcdefgh abcdefg abcdef abcdé " + "y" * 200
    (w,) = words(pa.array([text]))
    of, h = features(w)
    whole, four = h[:5], h[5:10]
    assert len(set(whole.tolist())) == 5 and set(of.tolist()) == {0}
    assert len(set(four.tolist())) == 2  # abcd (of four words) and yyyy
    entries = Entries(np.sort(whole[:2]), np.array([True, True]))
    text, place, pattern = observed(pa.array(["abcdefg x abcdefg abcdefgh", None, "", "AAA!!! !"]), entries)
    assert text.tolist() == [0, 0] and pattern.shape == (4, len(PATTERNS))
    assert pattern[:, PATTERNS.index("entries_2")].tolist() == [1, 0, 0, 0]
    assert pattern[:, PATTERNS.index("shouting")].tolist() == [0, 0, 0, 1] == pattern[:, PATTERNS.index("exclaiming")].tolist()


def test_telling_features_against_counts(spark):
    rows = corpus(240)
    _, labels = frames(spark, rows)
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    counts = {r["hash"]: (r["toxic"], r["clean"]) for r in feature_counts(sample.repartition(3)).collect()}
    bad = sum(y for *_, y in rows)
    best = telling(feature_counts(sample), bad, len(rows) - bad, size=20)
    (w,) = words(pa.array(["vilor grumbat the"]))
    known = features(w)[1].view(np.int64).tolist()
    assert counts[known[0]] == (sum(y for _, t, y in rows if "vilor" in t.split()), sum(1 - y for _, t, y in rows if "vilor" in t.split()))
    assert any(h in known for h, _ in best) and all(a[1] != 0 for a in best)


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.2
    vote = lambda hit, false: np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < false)
    a, b, c, d = vote(0.8, 0.05), vote(0.7, 0.1), vote(0.75, 0.02), vote(0.6, 0.2)
    copy = np.where(rng.random(len(y)) < 0.95, d, ~d)
    votes = np.stack([a, b, c, d, copy], axis=1).astype(np.uint8)
    annotator = np.where(rng.random(len(y)) < 0.15, ~y, y).astype(int)
    model = LabelModel(steps=40).fit(votes, annotator, 0.1 + 0.8 * annotator)
    assert np.abs(model.accuracy[1] - [0.8, 0.7, 0.75, 0.6, 0.58]).max() < 0.06
    assert model.annotation[1] > 0.78 and model.annotation[0] < 0.22
    assert np.unravel_index(model.correlation.argmax(), model.correlation.shape) in ((3, 4), (4, 3))
    assert model.parent[3] == 4 or model.parent[4] == 3
    right = ((model.posterior(votes, annotator) >= 0.5) == y).mean()
    assert right > (annotator == y).mean() + 0.05


def test_linear_classifier_on_soft_targets():
    row, col = np.array([0, 1, 1, 2, 3]), np.array([0, 0, 1, 1, 2])
    c = LinearClassifier().fit(np.tile(row, 50) + np.repeat(np.arange(50) * 4, 5), np.tile(col, 50), np.tile([0.9, 0.95, 0.8, 0.1], 50), 3)
    p = c.predict(row, col, 5)
    assert p[0] > 0.7 and p[1] > p[2] > 0.6 and p[3] < 0.3 and 0 < p[4] < 1


def test_pattern_names_match():
    assert len(module.PATTERNS) == module.patterns(pa.array(["a"]), *[np.zeros(1, np.int64)] * 3).shape[1]
