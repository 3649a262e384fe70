import re
from collections import Counter

import numpy as np
from llm_helpers import ODD_TEXTS, against_sql, rows_of

from procsig.llm import divergence as module
from procsig.llm.divergence import _ORACLE, _block_sums, divergence, op11_source_divergence


def share(n, total, v):
    return 1 + 1_000_000_000 * (n + 1) // (total + v)


def brute(rows, min_docs=3, top=200):
    docs, groups = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs.setdefault(lang, Counter()).update(set(terms))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
    out = []
    for lang, by in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        size = {s: sum(c[t] for t in kept) for s, c in by.items()}
        p = {s: {t: share(c[t], size[s], len(kept)) for t in kept} for s, c in by.items()}
        q = {t: share(sum(c[t] for c in by.values()), sum(size.values()), len(kept)) for t in kept}
        for s in by:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in by if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if by[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out, key=repr)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def test_odd_rows_against_brute_force(spark, odd_docs):
    rows = [(["en", "fr", None][i % 3], ["a", "b", None, "c", "é", "b2"][i % 6 if i % 3 else 0], t, 1)
            for k in range(4) for i, t in enumerate([*ODD_TEXTS, "the the cat cat cat", "THE cat " * (k + 1), f"only{'x' * k} once"])]
    docs = spark.createDataFrame(rows, "lang string, source string, text string, term int")
    assert rows_of(divergence(docs), *COLUMNS) == brute([r[:3] for r in rows])


def test_many_terms_sources_and_small_tables_of_counts(spark, monkeypatch):
    monkeypatch.setattr(module, "TILE", 5)
    words = lambda i: " ".join(f"w{'abcdefghij'[j % 10]}{'klmnop'[j * i % 6]}{'q' * (j % 17)}" for j in range(i % 40 * 3))
    rows = [("en" if i % 9 else "xx", f"s{i % 13 if i % 2 else 0}", words(i)) for i in range(260)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert rows_of(divergence(docs, top=7), *COLUMNS) == brute(rows, top=7)


def test_block_sums_use_the_complement():
    group, n, bit = np.array([0, 0, 1, 1, 1]), np.array([2, 1, 2, 1, 1]), np.array([0, 1, 0, 2, 3])
    share_of = lambda g, c: np.array([share(k, [3, 4, 0][i], 64) for i, k in zip(g.tolist(), c.tolist())])
    out = np.zeros((3, 3), np.int64)
    _block_sums(group, n, bit, 64, share_of, 3, out)
    count = np.zeros((3, 64), int)
    count[group, bit] = n
    p = np.array([[share(int(k), [3, 4, 0][g], 64) for k in count[g]] for g in range(3)])
    assert (out == ((p[:, None] - p[None]) ** 2 // p[None]).sum(axis=2)).all()


def test_no_kept_terms_and_empty_table(spark, odd_docs):
    docs = spark.createDataFrame([("en", "a", "one"), ("en", "b", None), ("en", "c", "two")], "lang string, source string, text string")
    assert rows_of(divergence(docs), *COLUMNS) == brute([("en", "a", "one"), ("en", "b", None), ("en", "c", "two")])
    assert divergence(odd_docs.limit(0)).count() == 0


def test_sql(spark, duck, sf):
    against_sql(spark, duck, sf, op11_source_divergence, _ORACLE)
