"""Toxicity scores by weak supervision: many voters, a generative label model, a linear classifier.

1. Features of a text are its distinct words and word beginnings (``PREFIXES`` bytes), as 64-bit hashes.
   Their document counts by label over the training sample are summed by Spark; the ``VOCABULARY`` most
   telling ones (G test) are kept.
2. Voters: one for each of the ``LEXICON`` most telling toxic entries, and patterns (how many different
   entries, how dense, none at all, shouting, exclamations, masked words). The labels of the sample are one
   more voter, an annotator who errs.
3. The label model estimates how often each voter is right and which voters go together, and gives every
   document of the sample a posterior label; a logistic regression on the vocabulary and the patterns is
   trained on these and scores all documents.

The model is fitted on a bounded sample of labelled rows: all of them up to ``MAX_LABELLED``, above that
those with the smallest hashes (a share of about ``MAX_LABELLED``); whole texts. Every document is scored.
Only labels of the given training rows are read; a score depends on the text alone.

Defined results: NULL, empty and wordless texts get the score of a text without any entry; a NULL
``doc_id`` counts as the empty string; several labels of one id count as their majority (ties: 1), several
texts of one id as the smallest; repeated rows are scored row by row; without labels of both kinds every score is the
share of label 1 (0 without labels); an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are ignored, whatever their names. Memory follows a segment of text, or one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.bytewords import Words, spread, string_buffers, words
from procsig.llm.labelmodel import LabelModel, LinearClassifier
from procsig.llm.registry import register
from procsig.llm.wordhash import mix
from procsig.session import cut_lineage
from procsig.sources.tables import table

MAX_LABELLED, VOCABULARY, LEXICON, MIN_TEXTS, MIN_G, MIN_ODDS = 20_000, 4_096, 48, 5, 11.0, 2.0
PREFIXES, FOLDS, THRESHOLD = (4, 5, 6), 5, 0.5
_PLACES = 64
_NUMBERS = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(_PLACES, 256)
_KIND = mix(np.arange(1, 12, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Names of the pattern voters, in the order of ``patterns``.
PATTERNS = ("entries_2", "entries_3", "entries_5", "entries_8", "dense", "very_dense", "none", "one_in_many", "shouting",
            "exclaiming", "masked")


def held_out(folds: int = FOLDS) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of the beginnings of longer words."""
    at, behind, first = spread(w.start, w.size)
    place = np.repeat(w.size, w.size) - 1 - behind
    whole = mix(np.add.reduceat(_NUMBERS[place & (_PLACES - 1), w.data[at]] * (2 * (place // _PLACES) + 1).astype(np.uint64), first)
                + w.size.astype(np.uint64))
    of, found = [w.text], [whole]
    rows, part = np.flatnonzero(w.size > PREFIXES[0]), None
    for k, n in enumerate(PREFIXES):
        if k:
            more = w.size[rows] > n
            rows, part = rows[more], part[more]
        begin = w.start[rows]
        for j in range(PREFIXES[k - 1] if k else 0, n):
            step = _NUMBERS[j][w.data[begin + j]]
            part = step if part is None else part + step
        of.append(w.text[rows])
        found.append(mix(part + _KIND[n]))
    return np.concatenate(of), np.concatenate(found)


def feature_counts(sample: DataFrame) -> DataFrame:
    """``sample(text, toxic)`` -> ``hash, toxic, clean``: texts of each label that hold the feature."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            label = b.column("toxic").to_numpy()
            seen = [np.empty(0, [("t", "<i8"), ("h", "<u8")])]
            for w in words(b.column("text")):
                of, h = features(w)
                pair = np.empty(len(of), seen[0].dtype)
                pair["t"], pair["h"] = of, h
                seen.append(np.unique(pair))
            pairs = np.unique(np.concatenate(seen))
            hashes, place = np.unique(pairs["h"], return_inverse=True)
            bad = np.bincount(place, label[pairs["t"]], minlength=len(hashes)).astype(np.int64)
            n = np.bincount(place, minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bad), pa.array(n - bad)], names=["hash", "toxic", "clean"])
    return (sample.select("text", "toxic").mapInArrow(count, "hash bigint, toxic bigint, clean bigint")
            .groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def telling(counts: DataFrame, toxic: int, clean: int, size: int = VOCABULARY) -> list[tuple[int, float]]:
    """(hash, log odds) of the features that tell the labels apart best (G statistic), best first."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n = float(toxic + clean)
    part = lambda x, of: F.when(x > 0, x * F.log(x * n / of)).otherwise(0.0)
    g = 2 * (part(a, (a + b) * toxic) + part(b, (a + b) * clean)
             + part(toxic - a, (n - a - b) * toxic) + part(clean - b, (n - a - b) * clean))
    odds = F.log((a + 0.5) * (clean - b + 0.5) / ((b + 0.5) * (toxic - a + 0.5)))
    rows = (counts.where(a + b >= MIN_TEXTS).select("hash", F.round(g, 6).alias("g"), odds.alias("odds")).where(F.col("g") >= MIN_G)
            .orderBy(F.desc("g"), "hash").limit(size).collect())
    return [(r["hash"], r["odds"]) for r in rows]


@dataclass
class Entries:
    """The vocabulary in lookup form: sorted hashes, a filter of their low bits, and which are lexicon entries."""
    hashes: np.ndarray
    lexicon: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h``, vocabulary places) of the known hashes."""
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        good = self.hashes[place] == h[at]
        return at[good], place[good]


def observed(column: pa.Array, entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, vocabulary place) of all distinct entries, and the pattern matrix (texts x ``PATTERNS``)."""
    n, size = len(column), max(1, len(entries.hashes))
    n_words, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs = np.empty(0, np.int64)
    for w in words(column):
        of, h = features(w)
        at, place = entries.find(h)
        whole = at < len(w.start)  # a hit of a whole word or of its beginning counts its word once
        n_words += np.bincount(w.text, minlength=n)
        toxic = entries.lexicon[place] if len(entries.lexicon) else np.zeros(0, bool)
        hits += np.bincount(of[at[toxic & whole]], minlength=n)
        pairs = np.union1d(pairs, of[at] * size + place)
    text, place = pairs // size, pairs % size
    different = np.bincount(text[entries.lexicon[place]], minlength=n) if len(place) else np.zeros(n, np.int64)
    return text, place, patterns(column, n_words, hits, different)


def patterns(column: pa.Array, n_words: np.ndarray, hits: np.ndarray, different: np.ndarray) -> np.ndarray:
    """One column of 0 and 1 per pattern voter."""
    capital, letter, bang, sign = (np.zeros(len(column), np.int64) for _ in range(4))
    data, offsets = string_buffers(column)
    for lo in range(int(offsets[0]), int(offsets[-1]), 1 << 21):
        part = data[lo:min(lo + (1 << 21), int(offsets[-1]))]
        first = int(np.searchsorted(offsets, lo, "right")) - 1
        last = int(np.searchsorted(offsets, lo + len(part), "left"))
        begins = np.maximum(offsets[first:last] - lo, 0)
        full = np.flatnonzero(np.diff(np.r_[begins, len(part)]) > 0)
        for total, kind in ((capital, _CAPITAL), (letter, _LETTER), (bang, _BANG), (sign, _SIGN)):
            total[first + full] += np.add.reduceat(kind[part], begins[full])
    many = n_words >= 100
    return np.stack([different >= 2, different >= 3, different >= 5, different >= 8, hits * 200 >= np.maximum(n_words, 1),
                     hits * 50 >= np.maximum(n_words, 1), different == 0, (different == 1) & many,
                     (capital * 2 > letter) & (letter > 0), bang >= 3, sign * 20 > np.maximum(letter, 1)], axis=1).astype(np.uint8)


_CAPITAL = np.array([65 <= b <= 90 for b in range(256)], dtype=np.int64)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)], dtype=np.int64)
_BANG = np.array([b == 0x21 for b in range(256)], dtype=np.int64)
_SIGN = np.array([chr(b) in "#*$%&@" for b in range(256)], dtype=np.int64)


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, bound: int = MAX_LABELLED) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, toxic)`` -> ``doc_id, text, toxic`` of training rows only.

    About ``bound`` rows at most, chosen by a hash of the id; the ids are broadcast (12 bytes a row).
    """
    one = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(folds))
           .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    n = one.count()
    if n > bound:
        one = one.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < bound * (1 << 30) // n)
    ids = one.select(F.col("doc_id").alias("labelled_id"), "toxic")
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))


@dataclass
class Model:
    entries: Entries
    classifier: LinearClassifier | None
    share: float
    label_model: LabelModel | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.classifier is None:
            return np.full(len(column), self.share)
        text, place, pattern = observed(column, self.entries)
        at, kind = np.nonzero(pattern)
        return self.classifier.predict(np.r_[text, at], np.r_[place, kind + len(self.entries.hashes)], len(column))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, bound: int = MAX_LABELLED) -> Model:
    """Voters, label model and classifier from the labelled training rows."""
    sample = cut_lineage(training_sample(docs, labels, folds, bound))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    share = n.get(1, 0) / max(1, sum(n.values()))
    nothing = Entries(np.empty(0, np.uint64), np.empty(0, bool))
    if len(n) < 2:
        return Model(nothing, None, share)
    best = telling(feature_counts(sample), n[1], n[0])
    hashes = np.array([h for h, _ in best], dtype=np.int64).view(np.uint64)
    odds = np.array([o for _, o in best])
    order = np.argsort(hashes)
    toxic = np.flatnonzero(odds >= MIN_ODDS)[:LEXICON]  # the most telling toxic ones
    in_lexicon = np.zeros(len(hashes), dtype=bool)
    in_lexicon[np.flatnonzero(odds >= MIN_ODDS)] = True
    voter = np.full(len(hashes), -1)
    voter[toxic] = np.arange(len(toxic))
    entries, voter = Entries(hashes[order], in_lexicon[order]), voter[order]

    def observe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text, place, pattern = observed(b.column("text"), entries)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
            bits = pattern.astype(np.int64) @ (1 << np.arange(len(PATTERNS)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(bits), b.column("toxic")],
                                             names=["doc_id", "entries", "patterns", "toxic"])
    seen = (sample.select("doc_id", "text", "toxic").mapInArrow(observe, "doc_id bigint, entries array<int>, patterns bigint, toxic int")
            .toArrow().combine_chunks().sort_by("doc_id"))  # the bounded sample
    place = seen.column("entries").combine_chunks().flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(seen.num_rows), np.diff(seen.column("entries").combine_chunks().offsets.to_numpy()))
    pattern = (seen.column("patterns").to_numpy()[:, None] >> np.arange(len(PATTERNS))) & 1
    label = seen.column("toxic").to_numpy().astype(np.int64)
    lexicon = np.zeros((seen.num_rows, len(toxic)), dtype=np.uint8)
    cast = voter[place] >= 0
    lexicon[row[cast], voter[place[cast]]] = 1
    votes = np.concatenate([lexicon, pattern.astype(np.uint8)], axis=1)
    label_model = LabelModel().fit(votes, label, 0.1 + 0.8 * label)
    posterior = label_model.posterior(votes, label)
    at, kind = np.nonzero(pattern)
    classifier = LinearClassifier().fit(np.r_[row, at], np.r_[place, kind + len(hashes)], posterior, len(hashes) + len(PATTERNS))
    return Model(entries, classifier, share, label_model)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, score, predicted`` for every row."""
    model = model or train(docs, labels, folds)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)))], names=["doc_id", "score"])
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@register("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
