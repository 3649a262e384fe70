import random

import numpy as np
import pytest
from llm_helpers import against_sql, rows_of
from pyspark.sql import functions as F

from procsig.llm import dedup
from procsig.llm.components import components
from procsig.llm.dedup import SQL, drop_near_duplicates, near_duplicates, op2_near_duplicates
from procsig.llm.superminhash import superminhash


def brute(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    sets = [grams(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        cid = min(ids, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), cid, doc == cid))
    return sorted(out, key=repr)


def family(rnd, n_docs, n_words, changes):
    """Near copies of one text, each with some words changed: similarities around the threshold."""
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(n_words)]
    out = []
    for _ in range(n_docs):
        t = list(base)
        for _ in range(rnd.randrange(changes + 1)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10 ** 6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block_docs,max_run", [(512, 2048), (7, 2048), (7, 3)])
def test_against_all_pairs(spark, monkeypatch, block_docs, max_run):
    monkeypatch.setattr(dedup, "MAX_RUN", max_run)
    rnd = random.Random(5)
    texts = [None, "", " \n", "a", "A", "a b", "one two three four five"]
    for k in range(4):
        texts += family(rnd, 15, 60, 4)
    texts += [texts[-1]] * 6
    chain = [f"c{i}" for i in range(80)]
    texts += [" ".join(chain[i:i + 60]) for i in range(0, 20, 3)]  # neighbours link, ends do not
    rnd.shuffle(texts)
    rows = [(None if i % 11 == 5 else i - i % 13 // 12, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS comp")
    got = rows_of(near_duplicates(docs, block_docs), "doc_id", "n_shingles", "component_id", "kept")
    assert [g[:3] for g in got] == [b[:3] for b in brute(rows)]
    assert all(kept == (d == c) for d, _, c, kept in got)


def test_drop_keeps_one_of_each_group(spark, odd_docs):
    left = drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    words = lambda t: (t or "").lower().split()
    assert [r["text"] for r in left.collect() if r["text"] == "tie tie tie"] == ["tie tie tie"]
    blank = sum(not words(r["text"]) for r in odd_docs.collect())
    assert sum(not words(r["text"]) for r in left.collect()) == blank
    twice = odd_docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    again = drop_near_duplicates(twice.unionByName(twice))
    assert again.where(r"text rlike '[^\\s]'").count() == drop_near_duplicates(twice).where(r"text rlike '[^\\s]'").count()


def test_empty_table(spark, odd_docs):
    assert near_duplicates(odd_docs.limit(0)).count() == 0
    assert near_duplicates(odd_docs.where("text IS NULL")).where("kept").count() == 1


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    want = [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 140)] + [(200, 200), (201, 200)]
    assert rows_of(got, "node", "root") == sorted(want, key=repr)


def test_signature_estimates_similarity_with_low_variance():
    rng = np.random.default_rng(0)
    est = []
    for n in (8, 60, 600):
        for _ in range(100):
            x = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
            k = n // 7
            s = superminhash([x[k:], x[:len(x) - k]])
            est.append((s[0] == s[1]).mean() - (n - 2 * k) / n)
    assert abs(np.mean(est)) < 0.01 and np.std(est) < 0.03
    one = superminhash([np.array([5], dtype=np.uint64), np.empty(0, dtype=np.uint64)])
    assert sorted(np.floor(one[0])) == list(range(256)) and np.isinf(one[1]).all()  # one element fills slot by slot


def test_sql(spark, duck, sf):
    against_sql(spark, duck, sf, op2_near_duplicates, SQL)


def test_components_over_many_tasks(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)]
    few = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    many = components(spark.createDataFrame(edges, "a bigint, b bigint"), task_edges=20)
    assert rows_of(few, "node", "root") == rows_of(many, "node", "root")
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_drop_keeps_unlinked_texts_of_null_and_reused_ids(spark):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (3, text("c")), (3, text("d")), (3, text("d") + " end"),
            (4, text("d")), (5, text("e")), (5, text("e")), (None, text("f")), (6, text("f")), (None, ""), (7, None)]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("root", F.lit("x")))
    got = [(r["doc_id"], (r["text"] or " ")[0]) for r in left.collect()]
    assert sorted(got, key=repr) == sorted([(None, "a"), (None, "b"), (3, "c"), (3, "d"), (5, "e"), (6, "f"), (None, " "), (7, " ")], key=repr)


def _form_letters(rnd, n, common, own):
    """Texts of one form: the same words, each with an insert of its own."""
    form = [f"f{rnd.randrange(10 ** 9)}" for _ in range(common)]
    return [" ".join(form[:common // 2] + [f"o{k}_{i}" for i in range(own)] + form[common // 2:]) for k in range(n)]


def test_family_of_unlinked_texts_gives_no_pairs(spark, monkeypatch):
    """A form letter with inserts (similarity about 0.64) spans blocks and links nothing."""
    found = []
    plain = dedup.spanning_candidates
    monkeypatch.setattr(dedup, "spanning_candidates", lambda sets, place: found.append(plain(sets, place)) or found[-1])
    texts = _form_letters(random.Random(3), 1500, 150, 36)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = near_duplicates(docs, block_docs=60)
    assert got.where("component_id <> doc_id").count() == 0
    assert found and found[0].count() < 10 * len(texts)


def test_pairs_at_the_threshold_across_blocks_are_linked(spark):
    """A family under the threshold, and in it pairs just over it: all of these link, in any blocks."""
    rnd = random.Random(9)
    rows, want = [], {}
    for k, t in enumerate(_form_letters(rnd, 120, 150, 40)):
        w = t.split()
        rows.append((2 * k, t))
        n = rnd.choice([6, 12, 15, 18])
        other = w[:75] + w[75:75 + 40 - n] + [f"z{k}_{i}" for i in range(n)] + w[115:]
        rows.append((2 * k + 1, " ".join(other)))
    for doc, n, comp, kept in brute(rows):
        want[doc] = comp
    assert 0 < sum(d != c for d, c in want.items()) < len(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block_docs=9)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_candidates_hold_every_linked_pair(spark):
    """Prefix, length and place bounds against all pairs, over sets of many sizes."""
    rnd = random.Random(2)
    sets = []
    for f in range(4):
        base = rnd.sample(range(10_000), 60)
        for _ in range(25):
            keep = rnd.sample(base, rnd.randrange(30, 61))
            sets.append(sorted(set(keep + rnd.sample(range(10_000), rnd.randrange(0, 16)))))
    rows = [(bytes([i]), b"c", np.array(x, dtype=np.int64).tobytes()) for i, x in enumerate(sets)]
    place = spark.createDataFrame([(bytes([i]), bytes([i]), i) for i in range(len(sets))], "fp binary, label binary, block int")
    got = dedup.spanning_candidates(spark.createDataFrame(rows, "fp binary, comp binary, grams binary"), place)
    pairs = {frozenset((r["a"][0], r["b"][0])) for r in got.collect()}
    linked = {frozenset((i, j)) for i in range(len(sets)) for j in range(i)
              if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    assert linked <= pairs and len(linked) > 20 and len(pairs) < len(sets) * (len(sets) - 1) / 6
