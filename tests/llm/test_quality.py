from llm_helpers import against_sql, rows_of

from procsig.llm.quality import _sql, op7_quality_rules, quality_rules


def brute(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, cover = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))


def test_metrics_of_odd_texts(spark, odd_docs):
    got = rows_of(quality_rules(odd_docs), "w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((r["w"], *brute(r["text"])) for r in odd_docs.collect()), key=repr)
    assert got == want


def test_base_rule_and_method(spark):
    good = " ".join(f"the word{i} of thing{i * 7}" for i in range(30))
    docs = spark.createDataFrame([(1, good), (2, "the short one"), (3, "same three words " * 40),
                                  (4, " ".join(f"x{i}###" for i in range(60))), (5, None)], "doc_id bigint, text string")
    assert rows_of(quality_rules(docs), "doc_id", "base_failed", "kept") == [
        (1, False, True), (2, True, False), (3, True, False), (4, False, False), (5, True, False)]


def test_empty_table(spark, odd_docs):
    assert quality_rules(odd_docs.limit(0)).count() == 0


def test_sql(spark, duck, sf):
    against_sql(spark, duck, sf, op7_quality_rules, _sql())
