import random

import public_tokenizers
import pytest
import regex
from llm_helpers import rows_of

from procsig.llm import token_edits
from procsig.llm.token_edits import VOCABULARY, TokenTree, derived_edits, edited_counts, op5_token_counts, piece_counts
from procsig.sources.tables import table

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
PAT = regex.compile(PATTERN)


def count(text):
    c = piece_counts(PATH)
    return sum(c[p] for p in PAT.findall(text))


@pytest.mark.parametrize("block,most", [(128, 512), (3, 7)])
def test_random_edits_equal_full_encoding(monkeypatch, block, most):
    monkeypatch.setattr(token_edits, "BLOCK", block)
    monkeypatch.setattr(token_edits, "MAX_BLOCK", most)
    rnd = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'ll", "'s", "1", "!", "é", " word", "\t"]
    for _ in range(60):
        text = "".join(rnd.choices(alphabet, k=rnd.randrange(0, 120)))
        tree = TokenTree(text, PAT, piece_counts(PATH))
        for _ in range(25):
            start, cut = rnd.randrange(0, len(text) + 1), rnd.choice([0, 0, 1, 2, 9])
            insert = "".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 1, 2, 6])))
            text = text[:start] + insert + text[start + cut:]
            tree.edit(start, cut, insert)
            assert tree.text() == text and tree.n_chars == len(text)
            assert [p for b in tree.blocks for p in b] == PAT.findall(text)
            assert tree.n_tokens == count(text)


def test_edit_touches_only_its_region():
    text = "some words in a row " * 5000
    tree = TokenTree(text, PAT, piece_counts(PATH))
    tree.edit(50_000, 3, "XY z")
    assert tree.reencoded < 12 and tree.n_tokens == count(text[:50_000] + "XY z" + text[50_003:])


def test_defined_cases(spark, odd_docs):
    docs = odd_docs.selectExpr("*", "1 AS kind", "2 AS seq")
    edits = spark.createDataFrame([(0, 2, 1, 1, "q"), (0, 1, None, None, " end"), (4, 1, -5, 99999, None), (4, 2, 10 ** 6, -3, "x"),
                                   (None, 1, 0, 0, "none"), (777, 1, 0, 0, "no such document")],
                                  "doc_id bigint, seq bigint, start bigint, n_delete bigint, insert string")

    def apply(doc_id, t):
        t = t or ""
        if doc_id == 0:
            t += " end"
            t = t[:1] + "q" + t[2:]
        if doc_id == 4:
            t = t[99999:] + "x"
        return count(t), len(t)
    want = [(r["doc_id"], count(r["text"] or ""), *apply(r["doc_id"], r["text"])) for r in docs.collect()]
    got = rows_of(edited_counts(docs, edits, PATH, PATTERN), "doc_id", "tokens_before", "tokens_after", "chars_after")
    assert got == sorted(want, key=repr)
    assert edited_counts(docs.limit(0), edits, PATH, PATTERN).count() == 0


def test_query_against_full_encoding(spark, sf):
    docs = table(spark, sf, "documents")
    edits = {}
    for e in derived_edits(docs).orderBy("doc_id", "seq").collect():
        edits.setdefault(e["doc_id"], []).append(e)
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        for e in edits[r["doc_id"]]:
            at = min(e["start"], len(t))
            t = t[:at] + e["insert"] + t[at + e["n_delete"]:]
        want.append((r["doc_id"], count(r["text"] or ""), count(t), len(t), 5))
    got = rows_of(op5_token_counts(spark, sf), "doc_id", "tokens_before", "tokens_after", "chars_after", "n_edits")
    assert got == sorted(want, key=repr)
