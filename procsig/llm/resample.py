"""Target-distribution importance resampling: array-scored weights, ranks by regular sampling.

Features are hashed runs of words. One pass counts the buckets of the corpus and of the target; the
log ratio of the two smoothed distributions gives every bucket a gain, and a second pass adds up the
gains of each document (``weight``). A Gumbel number per document makes the highest ``score`` rows a
draw without replacement in proportion to the weights.

Exact ranks come from parallel sorting by regular sampling: every partition is a sorted run, which is
written; every ``step``-th row of the runs gives the splitters; rows go to the task of their segment,
where the segments are merged by Spark's sort; the counts of the segments before it turn a row's place
into its rank. Segments behind the last drawn rank are never exchanged.

The driver holds bucket counts (``BUCKETS`` rows), at most about ``SAMPLES`` sampled keys and one count
per segment, whatever the input. Equal keys are told apart by the row's place in its run, so that any
number of tied or repeated rows is spread over segments.

Defined results: NULL, empty and wordless texts have no features, weight 0 and are never drawn; a NULL
``doc_id`` draws with the digest of ``42:`` and sorts behind others on ties; repeated rows are separate
candidates; with an empty target its distribution is flat; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored, whatever their names. Memory follows a segment of text,
or one word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm import crc
from procsig.llm.bytewords import Words, words
from procsig.llm.registry import register
from procsig.llm.text import ALNUM_WORD, sql_ascii_lower, sql_words
from procsig.session import cut_lineage
from procsig.sources.tables import table

#: Fixed values of the features: hashed buckets, longest run of words.
BUCKETS, RUN = 10_000, 3
MIN_WORDS, SHARE_PCT, SEED = 20, 5, 42
SAMPLES, SEGMENT_ROWS, MAX_SEGMENTS = 65_536, 50_000, 4_096


def feature_buckets(column: pa.Array, run: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, text of each word) per segment: one entry per run of 1 to ``run`` words."""
    held: list[np.ndarray] | None = None  # the last run - 1 words: linear checksum, the same behind a space, size, text
    for w in words(column):
        own, new = _checksums(w), len(w.start)
        one, spaced, size, text = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        old = len(one) - new
        of, found = [text[old:]], [(one ^ crc.start_value(size))[old:]]
        now, length = one, size
        for k in range(1, run):
            if len(now) < 2:
                break
            # Runs of k + 1 words that end at each word but the first k.
            now = crc.shifted(now[:-1], size[k:] + 1) ^ spaced[k:]
            length = length[:-1] + size[k:] + 1
            valid = text[k:] == text[:-k]
            valid[:max(0, old - k)] = False  # they end at a word of the segment before
            of.append(text[k:][valid])
            found.append((now ^ crc.start_value(length))[valid])
        yield np.concatenate(of), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), text[old:]
        keep = run - 1
        held = [x[max(0, len(x) - keep):] for x in (one, spaced, size, text)] if keep else None


def _checksums(w: Words) -> list[np.ndarray]:
    one = crc.raw(w.data, w.start, w.size)
    space = crc.shifted(np.full(len(one), crc._BASE[0x20], dtype=np.uint32), w.size)
    return [one, one ^ space, w.size.astype(np.int64), w.text]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``texts(text)`` -> ``bucket, n``: occurrences over all texts, summed per task before the shuffle."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in it:
            for _, bucket, _ in feature_buckets(b.column(0), buckets=buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])
    return texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket, the floored 1000-fold log ratio of the smoothed target and corpus shares."""
    both = bucket_counts(docs, buckets).withColumn("side", F.lit(0)).unionByName(
        bucket_counts(target, buckets).withColumn("side", F.lit(1)))
    count = [[0] * buckets, [0] * buckets]
    for r in both.collect():  # at most two rows per bucket
        count[r["side"]][r["bucket"]] = r["n"]
    s_all, t_all = map(sum, count)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets))))
                     for s, t in zip(*count)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, n_features, weight``."""
    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n_words, n_features, weight = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for of, bucket, per_word in feature_buckets(b.column(1), buckets=len(gain)):
                n_words += np.bincount(per_word, minlength=b.num_rows)
                n_features += np.bincount(of, minlength=b.num_rows)
                order = np.argsort(of, kind="stable")
                of, value = of[order], gain[bucket[order]]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                weight[of[first]] += np.add.reduceat(value, first)  # whole numbers, exact
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: int = SEED) -> Column:
    """Floored 1000-fold Gumbel number of the document's digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


_KEY = [("score", "<i8"), ("void", "<i8"), ("doc_id", "<i8"), ("row", "<i8")]


def _keys(b: pa.RecordBatch) -> np.ndarray:
    """Sortable keys of a batch: high scores first, then small ids (NULL last), then the row."""
    out = np.empty(b.num_rows, dtype=_KEY)
    doc = b.column("doc_id")
    out["score"] = -b.column("score").to_numpy()
    out["void"] = doc.is_null().to_numpy(zero_copy_only=False)
    out["doc_id"] = doc.fill_null(0).to_numpy()
    out["row"] = b.column("row").to_numpy()
    return out


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def regular_splitters(runs: DataFrame, rows: int, segments: int, samples: int = SAMPLES) -> np.ndarray:
    """Keys that cut the sorted ``runs`` into about equal segments: every ``step``-th row of each run is
    sampled (each run begins at a place of its own, so short runs count too), about ``samples`` in all."""
    step = max(1, rows // samples)

    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, next_at = 0, None
        for b in it:
            if not b.num_rows:
                continue
            if next_at is None:
                next_at = (int(b.column("row")[0].as_py()) >> 33) * 2654435761 % step
            at = np.arange(next_at - seen, b.num_rows, step)
            seen += b.num_rows
            next_at += step * len(at)
            yield b.take(pa.array(at, pa.int64()))
    if segments < 2:
        return np.empty(0, dtype=_KEY)
    got = runs.select("score", "doc_id", "row").mapInArrow(sample, "score bigint, doc_id bigint, row bigint").toArrow()
    keys = np.sort(np.concatenate([_keys(b) for b in got.to_batches()] or [np.empty(0, dtype=_KEY)]))
    return keys[(np.arange(1, segments) * len(keys)) // segments] if len(keys) else keys


def exact_ranks(scored: DataFrame, drawn: int | None, eligible: Column, segment_rows: int = SEGMENT_ROWS,
                samples: int = SAMPLES, draw_pct: int | None = None) -> DataFrame:
    """Add ``rank`` (1, 2, 3... by score, then id) to ``scored(doc_id, score, ...)``; NULL for rows that are
    not ``eligible`` or behind the ``drawn`` first (or the ``draw_pct`` percent of the eligible rows)."""
    others = [c for c in scored.columns]
    runs = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()).withColumn("eligible", eligible)
                       .sortWithinPartitions(F.desc("eligible"), *_order()))
    rows = runs.where("eligible").count()
    last = drawn if drawn is not None else draw_pct * rows // 100
    splits = regular_splitters(runs.where("eligible"), rows, min(MAX_SEGMENTS, rows // segment_rows + 1), samples)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seg = np.searchsorted(splits, _keys(b), side="right") if len(splits) else np.zeros(b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seg.astype(np.int32))], names=[*b.schema.names, "segment"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    dealt = runs.mapInArrow(deal, f"{schema}, segment int")
    count = np.zeros(len(splits) + 2, dtype=np.int64)
    for r in dealt.where("eligible").groupBy("segment").count().collect():  # one row per segment
        count[r["segment"] + 1] = r["count"]
    before = np.cumsum(count)  # rows in the segments before each
    needed = int(np.searchsorted(before, last, side="left"))  # segments 0 .. needed - 1 hold the drawn ranks

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, place = -1, 0
        for b in it:
            seg = b.column("segment").to_numpy()
            rank = np.empty(b.num_rows, dtype=np.int64)
            for lo, hi in _stretches(seg):
                place = place if seg[lo] == segment else 0
                segment = int(seg[lo])
                rank[lo:hi] = before[segment] + place + np.arange(1, hi - lo + 1)
                place += hi - lo
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(rank, mask=rank > last)], names=[*others, "rank"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields)
    drawn_part = F.col("eligible") & (F.col("segment") < needed)
    merged = (dealt.where(drawn_part).repartition(max(1, needed), "segment").sortWithinPartitions("segment", *_order())
              .mapInArrow(number, f"{fields}, rank bigint"))
    rest = dealt.where(~drawn_part).select(*others, F.lit(None).cast("bigint").alias("rank"))
    return merged.unionByName(rest)


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(x):
        cut = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]
        yield from zip(cut[:-1].tolist(), cut[1:].tolist())


def resample(docs: DataFrame, target: DataFrame, share_pct: int = SHARE_PCT, min_words: int = MIN_WORDS,
             seed: int = SEED, segment_rows: int = SEGMENT_ROWS, samples: int = SAMPLES) -> DataFrame:
    """``docs(doc_id, text)``, ``target(text)`` -> ``doc_id, n_words, n_features, weight, score, rank``."""
    scored = weights(docs, gains(docs, target)).withColumn("score", F.col("weight") + gumbel(seed))
    return exact_ranks(scored, None, F.col("n_words") >= min_words, segment_rows, samples, draw_pct=share_pct)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` was drawn (every row of a repeated id, if one of them was)."""
    ids = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["drawn_id"], "left_semi")


def _sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT side, doc_id, {' || chr(32) || '.join(f'w[i + {k}]' for k in range(n))} AS g FROM "
        f"(SELECT side, doc_id, w, unnest(range(1, len(w) + {2 - n})) AS i FROM t)" for n in range(1, RUN + 1))
    base = ", ".join(str(int(x)) for x in crc._BASE)
    return f"""
    WITH base AS (SELECT [{base}] AS t),
    t AS (SELECT 0 AS side, doc_id, {sql_words(sql_ascii_lower("text"), ALNUM_WORD)} AS w FROM documents
          UNION ALL SELECT 1, NULL, {sql_words(sql_ascii_lower("text"), ALNUM_WORD)} FROM benchmark),
    grams AS ({grams}),
    one AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
    bytes AS (SELECT g, [CAST('0x' || h[2 * k - 1:2 * k] AS BIGINT) FOR k IN range(1, length(h) // 2 + 1)] AS b FROM one),
    hashed AS (SELECT g, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket
               FROM bytes, base),
    f AS (SELECT side, doc_id, bucket FROM grams JOIN hashed USING (g)),
    c AS (SELECT b.bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t
          FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN f USING (bucket) GROUP BY b.bucket),
    gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS})))) AS BIGINT) AS gain
             FROM c, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c)),
    d AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
    scored AS (SELECT t.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                      CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || t.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
               FROM t LEFT JOIN d USING (doc_id) WHERE side = 0),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS})
    SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= {SHARE_PCT} * n // 100 THEN r END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)"""


@register("op12_importance_resampling", _sql())
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")
