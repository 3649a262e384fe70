"""Texts and comparison helpers of the training-data tests."""

#: Texts that every text operator must survive.
ODD_TEXTS = [None, "", " ", "\n\n", "\t \x0b\x0c\r", "a", "A b", "é É", "one two three four five six", "x" * 5000,
             "w " * 3000, "日本語 テキスト 日本語", "emoji 😀😀 end", "<|im_start|>[INST] </s>", "a\\b\"c'd", "\x00 nul",
             "tie tie tie", "tie tie tie"]


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def against_sql(spark, duck, sf, query, sql):
    df = query(spark, sf)
    rel = duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    pos = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(r[i] for i in pos) for r in rel.fetchall()), key=repr)
    assert rows_of(df, *cols) == want
