"""Benchmark decontamination: prefix-filtered set join on words, verified over item-sized windows.

A window is ``size`` consecutive item words (an item of fewer words is one window). A window can
only occur where all of its words do, so the prefix of its words in order of rarity is one word:
the rarest over all documents. The steps:

1. document frequencies of the benchmark's words, over all documents (one count per word);
2. every distinct window keeps its rarest word (ties: the smaller word) as its prefix token, with
   the word's offset in the window;
3. document positions holding a prefix token give candidate starts ``pos - offset``; the length
   and positional bounds ``0 <= start <= n_words - length`` drop those that cannot fit;
4. a candidate stands only if the document's slice equals the window word for word.

The window table has at most (benchmark words) rows. Up to ``broadcast_rows`` windows it is
broadcast and steps 3 and 4 are one pass without a shuffle: the explode, the hash probe and the
slice comparison run fused, so the word array is never copied per word. Beyond that bound the
candidates are joined by shuffles on the word, then on a row key of the document; the result is
the same.

Defined results: NULL, empty and wordless texts have no words and no hits; an empty benchmark
hits nothing; repeated items and rows count once per row; items with NULL id hit but are not
listed; documents with equal or NULL ids are told apart by row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.llm.text import ALNUM_WORD, alnum_words, packed, sql_ascii_lower, sql_words
from procsig.plans.guard import row_count_at_most
from procsig.session import cut_lineage
from procsig.sources.tables import table

WINDOW = 10
BROADCAST_ROWS = 1_000_000


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows ``(window, items)``: the word array and the sorted ids of its items."""
    w = items.select("item_id", alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (w.select("item_id", "w", F.explode(starts).alias("s"))
            .select("item_id", F.expr(f"slice(w, s, {size})").alias("window"))
            .groupBy("window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))


def prefix_tokens(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``token`` (the window's rarest word over ``docs``) and its ``offset`` from 0."""
    vocab = windows.select(F.explode("window").alias("word")).distinct()
    # Outer explodes: for an inner one the optimizer adds a filter that cuts the text a second time.
    seen = docs.select(F.explode_outer(alnum_words(F.col("text"))).alias("word"))
    if row_count_at_most(vocab, BROADCAST_ROWS) <= BROADCAST_ROWS:
        vocab = F.broadcast(vocab)
    counts = seen.join(vocab, "word", "left_semi").groupBy("word").count()
    ranked = (windows.select("window", "items", F.posexplode("window").alias("offset", "word"))
              .join(counts, "word", "left")
              .groupBy("window", "items")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("best")))
    return ranked.select("window", "items", F.col("best.word").alias("token"), F.col("best.offset").alias("offset"))


def occurrences(docs: DataFrame, windows: DataFrame, key: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified occurrences ``(key..., start, len, items)``; ``docs`` has ``key``, ``w`` and ``text``."""
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    exact = F.slice("w", F.col("pos") - F.col("offset") + 1, F.size("window")) == F.col("window")
    out = [*key, start.alias("start"), F.size("window").alias("len"), "items"]
    if row_count_at_most(windows, broadcast_rows) <= broadcast_rows:
        at = docs.select(*key, "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "token"))
        return at.join(F.broadcast(windows), "token").where(fits & exact).select(*out)
    at = docs.select(*key, F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "token"))
    found = at.join(windows, "token").where(fits).drop("token", "n_words")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}"))
    joined = docs.alias("d").join(found.alias("f"), same).select(
        *[F.col(f"d.{c}").alias(c) for c in key], "d.w", "f.pos", "f.offset", "f.window", "f.items")
    return joined.where(exact).select(*out)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, items`` (ids as sorted strings).

    Rows are told apart by ``doc_id`` and, for repeated ids, by the text's hash and length: two
    rows equal in all of these have equal results, so they are counted once and given out as
    often as they came.
    """
    windows = cut_lineage(prefix_tokens(item_windows(items, size), docs))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    key = ["doc_id", "text_key"]
    occ = occurrences(texts.select(*key, alnum_words(F.col("text")).alias("w")), windows, key, broadcast_rows)
    hits = occ.groupBy(*key).agg(
        F.collect_set(F.struct("start", "len")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"),
                       F.size(covered).cast("long").alias("n_hit"), "items")
    rows = texts.select(*key, F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    return (rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
            .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` (all columns) in which no benchmark window occurs."""
    windows = cut_lineage(prefix_tokens(item_windows(items, size), docs))
    key = ["doc_id", "text_key"]
    rows = packed(docs)
    marked = rows.select("doc_id", "text_key", alnum_words(F.col("text")).alias("w"))
    bad = occurrences(marked, windows, key).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_key")),
                     "left_anti").select("row_of.*")


SQL = f"""
WITH d AS (SELECT doc_id, {sql_words(sql_ascii_lower('text'), ALNUM_WORD)} AS w FROM documents),
b AS (SELECT item_id, {sql_words(sql_ascii_lower('text'), ALNUM_WORD)} AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (
          SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s
          FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x FROM (
          SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
          SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@register("op4_decontamination", SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
