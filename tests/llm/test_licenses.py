import re

import pytest
from llm_helpers import rows_of

from procsig.llm.licenses import BASE_PHRASES, evaluate, license_scan, normal_label, op6_license_scans, to_postfix
from procsig.sources.tables import table

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = W.findall((text or "").translate(LOWER))
    at = []
    for p, label in BASE_PHRASES.items():
        p = p.split()
        at += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = ["Released under the MIT License. Under the mit license under THE MIT-LICENSE!", "apache license, version 2.0", "cc by-nc cc by nc 4",
         "under the mit", "x under the mit licenses", "under the mit license", "SPDX-License-Identifier: MIT OR (GPL-2.0-only AND Apache-2.0)\nmore",
         "// SPDX-License-Identifier: GPL-3.0-or-later WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: ()", "éunder the mit license",
         "under the mit licenseé", "GNU General Public License, version 3", "cc\x00by\x7fnc"]


def test_places_and_labels(spark, odd_docs):
    docs = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])], "doc_id bigint, text string")
    docs = docs.unionByName(odd_docs.select("doc_id", "text")).selectExpr("*", "1 AS n_words", "2 AS spans")
    got = rows_of(license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=repr)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan(docs.where("doc_id IN (7, 8, 11)")).collect()}
    assert labels == {7: ("gpl", 0.0), 8: ("", 0.0), 11: ("gpl", 0.0)}
    assert license_scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,postfix", [
    ("MIT OR GPL-2.0 AND BSD-3-Clause", ["MIT", "GPL-2.0", "BSD-3-Clause", "and", "or"]),
    ("(MIT OR GPL-2.0) AND BSD", ["MIT", "GPL-2.0", "or", "BSD", "and"]),
    ("A WITH x OR B", ["A", "x", "with", "B", "or"]), ("MIT for this file", ["MIT"]), ("MIT OR", ["MIT"]), ("(MIT", ["MIT"]),
    ("((MIT) AND", ["MIT"]), ("", []), ("()", []), ("AND MIT", []), ("MIT)", ["MIT"]), ("A AND (", ["A"]), ("A AND (B OR", ["A", "B", "and"])])
def test_shunting_yard(text, postfix):
    assert to_postfix(text) == postfix


def test_evaluation():
    check = lambda e: evaluate(to_postfix(e))
    assert check("MIT OR GPL-2.0") == ({"mit", "gpl"}, True) and check("MIT AND GPL-2.0") == ({"mit", "gpl"}, False)
    assert check("(MIT OR GPL-2.0) AND Apache-2.0") == ({"mit", "gpl", "apache-2"}, True)
    assert check("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl"}, False) and check("") == (set(), False)
    assert [normal_label(x) for x in ("Apache-2.0", "CC-BY-NC-4.0", "LGPL-2.1+", "Zlib")] == ["apache-2", "cc-by-nc", "lgpl", "zlib"]


def test_query_reads_every_document(spark, sf):
    got = {r["doc_id"]: r for r in op6_license_scans(spark, sf).collect()}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        n, n_base, first, last, base = brute(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (n, n_base, first, last, base)
        assert set(filter(None, base.split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
