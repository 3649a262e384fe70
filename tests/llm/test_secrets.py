import random

import numpy as np
from llm_helpers import rows_of

from procsig.llm.forest import RandomForest
from procsig.llm.secrets import FEATURES, MASK, candidates, features, labelled_sample, op8_secret_scans, redact, scan, secret_scan, train
from procsig.sources.tables import table


def corpus(rnd, n):
    """Texts with planted secrets and with look-alikes (numbers, word chains, addresses)."""
    words = ["the", "house", "walks", "over", "green", "river", "stone", "light", "under", "tree", "paper", "morning"]
    hexs = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    b64 = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    out = []
    for i in range(n):
        t = " ".join(rnd.choices(words, k=25))
        secret = None
        kind = i % 6
        if kind == 0:
            secret = rnd.choice([hexs(40), b64(32)])
            t += f' {rnd.choice(["token", "API_KEY", "password", "client_secret"])} = "{secret}" ' + " ".join(rnd.choices(words, k=5))
        elif kind == 1:
            t += " " + "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(16, 22))) + " done"
        elif kind == 2:
            t += " " + "-".join(rnd.choices(words, k=5)) + "-" + str(rnd.randrange(9))
        elif kind == 3:
            t += f" http://site.example.com/{'/'.join(rnd.choices(words, k=4))}{rnd.randrange(100)}/x"
        out.append((i, t, secret))
    return out


def test_held_out_accuracy(spark):
    rnd = random.Random(8)
    train_rows, test_rows = corpus(rnd, 600), corpus(rnd, 300)
    frame = lambda rows: spark.createDataFrame([(i, t, "src") for i, t, _ in rows], "doc_id bigint, text string, path string")
    model = train(frame(train_rows))
    assert model[1] is not None
    got = {r["doc_id"]: r for r in scan(frame(test_rows), model, keep=["doc_id"]).collect()}
    right = 0
    for i, t, secret in test_rows:
        found = [t[f["start"]:f["start"] + f["length"]] for f in got[i]["findings"] if f["secret"]]
        right += found == ([secret] if secret else [])
        if secret and found == [secret]:
            assert got[i]["redacted"] == t.replace(secret, MASK)
    assert right >= 0.98 * len(test_rows)


def test_odd_input(spark, odd_docs):
    docs = odd_docs.selectExpr("*", "'x' AS path", "2 AS c0", "3 AS findings")
    out = redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert rows_of(out, "w", "text") == rows_of(docs, "w", "text")  # nothing to mask
    assert redact(docs.limit(0)).count() == 0 and secret_scan(odd_docs.limit(0)).count() == 0
    long = "k" * 100 + "1" + "9aB" * 3000
    assert list(candidates(long)) == [(0, len(long))] and list(candidates("a" * 40 + " " + "A" * 40)) == []


def test_labelled_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i, t, "src") for i, t, _ in corpus(random.Random(8), 200)], "doc_id bigint, text string, path string")
    x, y = labelled_sample(docs, ["the", "house"], bound=20)
    x2, _ = labelled_sample(docs.repartition(5), ["the", "house"], bound=20)
    assert len(y) <= 20 and set(y.tolist()) == {0, 1} and np.array_equal(x, x2)


def test_forest_on_known_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(int)
    f = RandomForest().fit(x[:1500], y[:1500])
    assert ((f.predict(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95


def test_query_returns_every_document(spark):
    sf = "/root/testdata/sf0.01"
    got = op8_secret_scans(spark, sf)
    assert got.count() == table(spark, sf, "documents").count()
    planted = table(spark, sf, "documents").where("lower(text) rlike 'token = \"[0-9a-f]{40}\"'").select("doc_id")
    found = got.where("n_secrets > 0").select("doc_id")
    assert planted.count() > 0 and planted.exceptAll(found).count() == 0


def test_short_and_signed_values_of_secret_names(spark):
    text = 'x password = "Tr0ub4dor&3!x" y PWD=p4$$w0rd#9 z api_key: \'k9#Zq!aaaabbbbccccdddd1111\' token = "' + "0a" * 20 + '" end'
    values = ["Tr0ub4dor&3!x", "p4$$w0rd#9", "k9#Zq!aaaabbbbccccdddd1111", "0a" * 20]
    assert [text[lo:hi] for lo, hi in candidates(text)] == values
    rnd = random.Random(8)
    rows = [(i, t, "src") for i, t, _ in corpus(rnd, 300)]
    short = lambda: "".join(rnd.choice("abcdefgh123456789#$!&XYZ") for _ in range(rnd.randrange(8, 16)))
    rows += [(i, f"the house walks over {rnd.choice(['password = ', 'pwd: ', 'PWD='])}{q}{short()}{q} green river", "src")
             for i in range(300) for q in ('"' if i % 2 else "",)]
    rows += [(i, f"under the tree password: {w} green river", "src") for i, w in enumerate(["house", "morning", "light"] * 5)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, path string")
    got = scan(frame([(1, text, "src")]), train(frame(rows)), keep=["doc_id"]).first()["redacted"]
    for v in values:
        text = text.replace(v, MASK)
    assert got == text


def test_features_describe_the_whole_candidate():
    text = "a1" * 2048 + "B" * 4096
    f = dict(zip(FEATURES, features(text, 0, len(text), "src", None)))
    assert f["digits"] == f["lower"] == 0.25 and f["upper"] == 0.5 and f["hex"] == 1.0 and f["entropy"] == 1.5
    assert abs(f["transitions"] - 4096 / len(text)) < 1e-9
