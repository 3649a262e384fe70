"""Source divergence audit: chi-square sums between all groups of a class, from count-level bitmaps.

A group is a (lang, source) pair; its share of a term is p = 1 + floor(10^9 (n + 1) / (N + V)) over the
V terms that its lang keeps, those in at least ``MIN_DOCS`` of the lang's documents. The divergence of a
group from another adds f = floor((p - q)^2 / q) over all kept terms, also those that neither holds.

Terms of a lang get ids in order of frequency; 64 ids make a block. For every (group, count) of a block
one 64-bit set holds the ids that the group has with that count, and the ids it lacks are the complement
of the union of its sets. AND and popcount of two sets give the number of terms in a joint cell
(count here, count there), which is multiplied by f of the two shares: equal counts are computed once,
terms in the order of frequency make few levels per block, and terms outside both groups cost one cell.

Counts are summed per task, then shuffled once by (lang, term) and summed by (lang, source, term): one
row per kept term with at most one entry per source of the lang. Blocks are ranges of that table, spread
evenly over tasks whatever a group's share of the rows; a task adds up its blocks per pair of groups.
The driver holds one row per group (the result has a row per pair of them); inside, groups are numbers.
The arithmetic is exact: shares by whole numbers of any size, sums of f stay below 2^63.

Defined results: NULL text, lang and source count as ''; texts without terms still make their group
occur; repeated rows are separate documents; a lang without kept terms gives 0 for its pairs and no
``term`` rows; equal values are ranked by the UTF-8 bytes of the item; an empty table gives an empty
result; other columns are ignored, whatever their names. Memory follows one text and a bounded table of
counts per task, and sources squared per lang.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsig.llm.bytewords import ALPHA, LOWER
from procsig.llm.registry import register
from procsig.llm.text import sql_ascii_lower
from procsig.plans.guard import collect_bounded
from procsig.session import cut_lineage
from procsig.sources.tables import table

#: Fixed values of the audit: documents that keep a term, scale of a share, ranks of the term part.
MIN_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Fixed value: the term class.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Entries that a task counts before it passes them on; groups whose pairs the result may list.
HELD, MAX_GROUPS = 600_000, 200_000
#: A part of a task counts a term's occurrences in the low bits of a number and its documents in the high ones.
_DOCS = 40
_ONE_DOC, _LOW = 1 << _DOCS, (1 << _DOCS) - 1
#: Groups of a lang that one pass of a task compares with each other.
TILE = 64

_TRANSLATE = bytes(int(LOWER[b]) if ALPHA[b] else 0x20 for b in range(256))


def group_table(docs: DataFrame) -> list[tuple[str, str]]:
    """All (lang, source) pairs that occur, NULL as '', sorted; a group's number is its place."""
    pairs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return sorted((r["lang"], r["source"]) for r in collect_bounded(pairs, MAX_GROUPS))


def term_counts(docs: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """``docs(lang, source, text)`` -> ``lang, group, term, n, docs``: sums of parts of a task; ``lang`` is the
    number of the lang's first group."""
    number = {g: i for i, g in enumerate(groups)}
    first: dict[str, int] = {}
    for i, (lang, _) in enumerate(groups):
        first.setdefault(lang, i)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], dict[bytes, int]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for g, n in seen.items():
                both = np.fromiter(n.values(), dtype=np.int64, count=len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), first[g[0]], np.int32)), pa.array(np.full(len(n), number[g], np.int32)),
                     pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(both & _LOW), pa.array(both >> _DOCS)],
                    names=["lang", "group", "term", "n", "docs"])
        for b in it:
            langs, sources = (b.column(c).to_pylist() for c in ("lang", "source"))
            for i, t in enumerate(b.column("text")):
                if not t.is_valid:
                    continue
                group = seen.setdefault((langs[i], sources[i]), {})
                held -= len(group)
                get = group.get
                for term, n in Counter(t.as_buffer().to_pybytes().translate(_TRANSLATE).split()).items():
                    group[term] = get(term, 0) + n + _ONE_DOC
                held += len(group)
                if held > HELD:
                    yield from out()
                    seen, held = {}, 0
        yield from out()
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return plain.mapInArrow(count, "lang int, group int, term string, n bigint, docs bigint")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, total, cells array<struct<group, n>>, id``: kept terms by falling frequency. Ids are places in
    the sorted, written table."""
    terms = (counts.repartition("lang", "term").groupBy("lang", "group", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
             .groupBy("lang", "term")
             .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("group", "n")).alias("cells"))
             .where(F.col("docs") >= min_docs))
    order = ["lang", F.desc("total"), "term"]
    ranged = cut_lineage(terms.drop("docs").repartitionByRange(*order).sortWithinPartitions(*order))
    return ranged.withColumn("id", F.monotonically_increasing_id())


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact."""
    if not len(n) or int(n.max()) + 1 < (1 << 63) // SCALE:
        return 1 + SCALE * (n + 1) // (total + terms)
    return np.array([1 + SCALE * (a + 1) // (b + terms) for a, b in zip(n.tolist(), total.tolist())], dtype=np.int64)


def _block_sums(group: np.ndarray, n: np.ndarray, bit: np.ndarray, size: int, share_of, groups: int, out: np.ndarray) -> None:
    """Add a block of ``size`` terms to ``out[a, b]``, the sums of f between groups.

    ``group, n, bit``: the block's entries; ``share_of(groups, counts)`` gives their shares.
    """
    order = np.lexsort((n, group))
    group, n, bit = group[order], n[order], np.left_shift(np.uint64(1), bit[order].astype(np.uint64))
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (n[1:] != n[:-1])]) if len(group) else np.empty(0, np.int64)
    bits = np.bitwise_or.reduceat(bit, first) if len(first) else np.empty(0, np.uint64)
    held = np.zeros(groups, dtype=np.uint64)
    np.bitwise_or.at(held, group[first], bits)
    all_ids = np.uint64((1 << size) - 1)
    of = np.concatenate([group[first], np.arange(groups)])
    bits = np.concatenate([bits, ~held & all_ids])
    p = share_of(of, np.concatenate([n[first], np.zeros(groups, np.int64)]))
    there = bits != 0
    of, bits, p = of[there], bits[there], p[there]
    by_tile = np.argsort(of, kind="stable")
    of, bits, p = of[by_tile], bits[by_tile], p[by_tile]
    edge = np.searchsorted(of, np.arange(0, groups + TILE, TILE))
    for a in range(len(edge) - 1):
        for b in range(len(edge) - 1):
            x, y = slice(edge[a], edge[a + 1]), slice(edge[b], edge[b + 1])
            joint = np.bitwise_count(bits[x, None] & bits[None, y])
            i, j = np.nonzero(joint)
            i, j = i + edge[a], j + edge[b]
            d = p[i] - p[j]
            np.add.at(out, (of[i], of[j]), d * d // p[j] * joint[joint > 0].astype(np.int64))


def pair_sums(terms: DataFrame, groups: list[tuple[str, str]], size: np.ndarray, kept: dict[int, int]) -> DataFrame:
    """``lang, a, b, value``: sums of f between the groups of each lang, one partial sum per task.

    ``size[group]`` is a group's N, ``kept[lang]`` the lang's number of kept terms.
    """
    langs = [lang for lang, _ in groups]

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, out, n_groups, held = -1, None, 0, []

        def block() -> None:
            if held:
                group, n, per = (np.concatenate([x[k] for x in held]) for k in range(3))
                _block_sums(group - lang, n, np.repeat(np.arange(len(per)), per), len(per),
                            lambda of, k: shares(k, size[lang + of], kept[lang]), n_groups, out)
                held.clear()

        def end() -> pa.RecordBatch:
            a, b = np.nonzero(out)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), lang, np.int32)), pa.array((a + lang).astype(np.int32)),
                                               pa.array((b + lang).astype(np.int32)), pa.array(out[a, b])], names=["lang", "a", "b", "value"])
        for batch in it:
            of = batch.column("lang").to_numpy()
            cells = batch.column("cells")
            starts, inner = cells.offsets.to_numpy(), cells.values
            group, n = inner.field("group").to_numpy().astype(np.int64), inner.field("n").to_numpy()
            at = 0
            while at < len(of):
                if of[at] != lang:
                    block()
                    if out is not None:
                        yield end()
                    lang = int(of[at])
                    n_groups = langs.count(langs[lang])
                    out = np.zeros((n_groups, n_groups), dtype=np.int64)
                have = sum(len(x[2]) for x in held)
                to = min(at + 64 - have, int(np.searchsorted(of, lang, "right")))
                part = slice(int(starts[at]), int(starts[to]))
                held.append((group[part], n[part], np.diff(starts[at:to + 1])))
                if have + to - at == 64:
                    block()
                at = to
        block()
        if out is not None:
            yield end()
    return (terms.select("lang", "cells").mapInArrow(sums, "lang int, a int, b int, value bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def _share_sql(n: str, total: str, terms: str) -> str:
    """The share as a Spark expression, exact for counts of any size."""
    return f"(1 + (cast({SCALE} AS decimal(10,0)) * cast({n} + 1 AS decimal(20,0))) div cast({total} + {terms} AS decimal(20,0)))"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``docs(lang, source, text)`` -> ``lang, source, part, item, value, rank``."""
    spark = docs.sparkSession
    groups = group_table(docs)
    terms = kept_terms(term_counts(docs, groups), min_docs)
    cells = terms.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.group", "c.n")
    size = np.zeros(len(groups), dtype=np.int64)
    for r in cells.groupBy("group").agg(F.sum("n").alias("n")).collect():  # one row per group
        size[r["group"]] = r["n"]
    kept = {r["lang"]: r["n"] for r in terms.groupBy("lang").agg(F.count("term").alias("n")).collect()}  # one row per lang
    first: dict[str, int] = {}
    whole: Counter = Counter()
    for i, (lang, _) in enumerate(groups):
        first.setdefault(lang, i)
        whole[lang] += int(size[i])
    known = spark.createDataFrame([(first[lang], i, lang, source, int(size[i]), whole[lang], kept.get(first[lang], 0))
                                   for i, (lang, source) in enumerate(groups)],
                                  "lang_no int, group int, lang string, source string, size bigint, lang_size bigint, terms bigint")
    found = pair_sums(terms, groups, size, kept).select("a", "b", "value")
    pairs = (known.select("lang_no", F.col("group").alias("a"), "lang", "source")
             .join(known.select("lang_no", F.col("group").alias("b"), F.col("source").alias("item")), "lang_no").where("a <> b")
             .join(found, ["a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    shares_ = (cells.drop("lang").join(known, "group")
               .select("group", F.col("term").alias("item"), F.expr(_share_sql("n", "size", "terms")).alias("p"),
                       F.expr(_share_sql("total", "lang_size", "terms")).alias("q"))
               .where("p > q").select("group", "item", F.expr("(p - q) * (p - q) div q").alias("value")))
    by_group = Window.partitionBy("group").orderBy(F.desc("value"), "item")
    tops = (shares_.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top).join(known, "group")
            .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return ranked.unionByName(tops)


_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({sql_ascii_lower("coalesce(text, '')")}, '{TERM}') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, source, sum(n) AS size FROM n GROUP BY lang, source),
every AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
                 1 + ({SCALE}::HUGEINT * (coalesce(n.n, 0) + 1)) // (coalesce(size, 0) + v) AS p
          FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN size USING (lang, source)),
whole AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
          FROM n JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
         FROM every JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""


@register("op11_source_divergence", _ORACLE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))
