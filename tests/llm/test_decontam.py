import random
import re

import pytest
from llm_helpers import against_sql, rows_of

from procsig.llm.decontam import SQL, contamination, decontaminate, op4_decontamination

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, size=10):
    words = W.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        iw = W.findall((t or "").translate(LOWER))
        n = min(size, len(iw))
        wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_random_texts_both_plans(spark, broadcast_rows):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 9, 10, 14])))) for i in range(12)]
    items += [(3, "w1 w2 w3"), (50, None), (51, ""), (52, "--- !!"), (53, items[0][1])]
    docs = []
    for i in range(60):
        words = rnd.choices(vocab, k=rnd.randrange(0, 60))
        if i % 2:
            at = rnd.randrange(0, len(words) + 1)
            words[at:at] = (rnd.choice(items)[1] or "").split()
        docs.append((i // 2, ", ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(None, items[1][1]), (None, items[1][1]), (99, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS w", "2 AS pos")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "3 AS token")
    got = rows_of(contamination(d, b, broadcast_rows=broadcast_rows), "doc_id", "n_words", "n_hit", "items")
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=repr)


def test_decontaminate_and_empty_tables(spark, odd_docs):
    bench = spark.createDataFrame([(1, "two three"), (None, "日本語")], "item_id bigint, text string")
    left = decontaminate(odd_docs, bench)
    assert left.columns == odd_docs.columns
    assert left.count() == odd_docs.count() - 2
    none = bench.limit(0)
    assert decontaminate(odd_docs, none).count() == odd_docs.count()
    assert contamination(odd_docs.limit(0), bench).count() == 0
    assert rows_of(contamination(odd_docs, none).where("n_hit > 0"), "doc_id") == []


def test_sql(spark, duck, sf):
    against_sql(spark, duck, sf, op4_decontamination, SQL)
