"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

Each rule names a metric and the range it must keep to. The metrics are length, symbol,
stop-word, line and repetition figures over the whole text, computed row by row inside one
projection: no shuffle, no Python, and one document is the largest unit of work.

Defined results: NULL and empty texts have no words, all counts 0, and fail the base rule;
repeated rows are judged row by row; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.llm.text import SPACE_WORD, ascii_lower, packed, space_words, sql_ascii_lower, sql_words
from procsig.sources.tables import table

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Common function words of the corpus languages (en, fr, de, es).
STOP_WORDS = ("the of and to in is that it on for as with was be by at are this have from or "
              "le la les de des du et en un une que qui dans pour par sur au est "
              "der die das und zu den von mit ist ein eine nicht sich auf im "
              "el los las y del se por con no para es lo").split()


@dataclass(frozen=True)
class Rule:
    """Keep a document whose ``metric`` lies in [low, high]; NULL bounds are open."""
    metric: str
    low: float | None
    high: float | None


#: The threshold table. Ratios of an empty denominator count as 0.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.5),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.01, None),
)
MIN_WORDS, MAX_REPEAT_PCT = 50, 50


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression over the metric columns."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.metric) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.metric) <= r.high)
    return ok


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the metric columns (prefix ``q_`` for inner arrays, which are dropped again).

    Repeated three-word windows: each window is one 64-bit hash of its words; only a text with
    a repeated hash sorts its (hash, position) pairs to find which windows repeat.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("q_words", space_words(F.col(text)))
    df = df.withColumn("n_words", F.size("q_words").cast("long"))
    df = df.withColumn("q_tri", F.slice(
        F.transform("q_words", lambda w, i: F.xxhash64(w, F.get("q_words", i + 1), F.get("q_words", i + 2))),
        F.lit(1), F.greatest(F.size("q_words") - 2, F.lit(0))))
    df = df.withColumn("q_sorted", F.when(
        F.size(F.array_distinct("q_tri")) < F.size("q_tri"),
        F.sort_array(F.transform("q_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("q_sorted", i - 1)["h"] == x["h"]) | (F.get("q_sorted", i + 1)["h"] == x["h"])
    repeated = F.filter("q_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
    df = df.withColumn("q_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = (df
          .withColumn("word_chars", F.char_length(F.array_join("q_words", "")).cast("long"))
          .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"))
          .withColumn("n_lines", F.size("q_lines").cast("long"))
          .withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
          .withColumn("n_stop_words", F.size(F.filter(
              F.split(ascii_lower(F.array_join("q_words", " ")), " "), lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long")))
    return df.drop("q_words", "q_tri", "q_sorted", "q_lines")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Metrics plus ``base_failed`` and ``kept`` for every row."""
    df = quality_metrics(docs, text)
    df = (df.withColumn("mean_word_chars", _ratio(F.col("word_chars"), F.col("n_words")))
          .withColumn("symbols_per_word", _ratio(F.col("n_symbols"), F.col("n_words")))
          .withColumn("dup_line_ratio", _ratio(F.col("n_dup_lines"), F.col("n_lines")))
          .withColumn("stop_word_ratio", _ratio(F.col("n_stop_words"), F.col("n_words"))))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) that the rules keep.

    The row number in the condition keeps the optimizer from moving the verdict below the metrics,
    where each of them would be computed many times over.
    """
    judged = quality_rules(packed(docs)).withColumn("q_row", F.monotonically_increasing_id())
    return judged.where("kept AND q_row >= 0").select("row_of.*")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    checks = " AND ".join(f"{r.metric} {op} {v}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {sql_words('text', SPACE_WORD)} AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
               FROM documents),
    tri AS (SELECT doc_id, i, {', '.join(f'w[i + {k}] AS w{k}' for k in range(3))}
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (
              SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w0, w1, w2) AS c FROM tri), (SELECT unnest([0, 1, 2]) AS k)
            WHERE c > 1 GROUP BY doc_id),
    m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 length(x) - length(regexp_replace(x, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
                 len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                 coalesce(rep.n, 0) AS n_repeat_words,
                 len(list_filter(w, lambda v: {sql_ascii_lower('v')} IN ({stop}))) AS n_stop
          FROM t LEFT JOIN rep USING (doc_id)),
    r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
                 coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
                 coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
                 coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
                 coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {checks} AS kept FROM r"""


@register("op7_quality_rules", _sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept")
