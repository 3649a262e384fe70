"""Secret scans: a random forest removes false positives among secret-like candidates.

Candidates are runs of 16 or more token characters that hold a digit or change case, and whole values
assigned to a secret-like name (quoted, or up to white space), of any length and signs. Features:
length, character classes and transitions between them, entropy, dictionary coverage (the most
frequent words of all documents), the path of the document and the neighbouring words and signs.

The forest is trained from labelled findings. ``label_findings`` labels the clear ones from their
form and place (an assignment to a secret-like name with a mixed value; a plain number; a value
made of dictionary words; an address); a labelled table of one's own can be passed instead. It is
fitted on at most ``MAX_LABELLED`` findings, those with the smallest hashes; dictionary counts cover
all documents and keep about the ``DICTIONARY`` most frequent words. Both are cut by a threshold that Spark
finds from counts first, so the driver gets the rows it keeps and no list of every partition. All findings of
all documents are scored. Without findings of both labels, the labels alone decide.

Defined results: NULL and empty texts have no candidates; a candidate may be as long as its text;
repeated rows are scanned row by row; equal values are judged on their own, each by its place; an empty table gives an empty result; columns other than
``doc_id``, ``text`` and the path column are ignored. Memory is bounded by one text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.forest import RandomForest
from procsig.llm.registry import register
from procsig.session import cut_lineage
from procsig.sources.tables import table

MIN_CHARS, MAX_LABELLED, DICTIONARY, THRESHOLD = 16, 20_000, 20_000, 0.5
MASK = "[SECRET]"

_CANDIDATE = re.compile(r"[A-Za-z0-9_+/\-]{16,}={0,2}")
_NAME = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential|auth|bearer)\w*"
                   r"[\"']?\s*(?:[:=]|=>|\s)\s*[\"']?$")
#: A value assigned to a secret-like name; the repeats are bounded, so that no text takes quadratic time.
_VALUE = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential|auth(?!or)|bearer)\w{0,32}"
                    r"[\"']?\s{0,4}(?:=>|[:=])\s{0,4}"
                    r"(?:\"((?:\\.|[^\"\\\n])+)\"|'((?:\\.|[^'\\\n])+)'|[\"']?([^\s\"']\S*))")
_PATH = re.compile(r"(?i)test|example|sample|doc|fixture|mock")
_WORDS = re.compile(r"[a-z]{3,12}")
FEATURES = ("length", "digits", "lower", "upper", "signs", "transitions", "entropy", "distinct", "hex", "coverage",
            "secret_name", "assigned", "quoted", "after_sign", "address", "path_hint", "words_before", "line_position")


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans in order, none over another: assigned values, and runs outside of them."""
    values = [m.span(m.lastindex) for m in _VALUE.finditer(text)]
    at = 0
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if not any(c.isdigit() for c in s) and (s[1:].islower() or s[1:].isupper()):
            continue
        lo, hi = m.span()
        while at < len(values) and values[at][0] < hi:
            if lo < values[at][0] and values[at][0] - lo >= MIN_CHARS:
                yield lo, values[at][0]
            yield values[at]
            lo = max(lo, values[at][1])
            at += 1
        if at and lo < values[at - 1][1]:
            lo = values[at - 1][1]
        if hi - lo >= MIN_CHARS:
            yield lo, hi
    yield from values[at:]


def dictionary_automaton(words: list[str]) -> ahocorasick.Automaton | None:
    if not words:
        return None
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def coverage(s: str, automaton: ahocorasick.Automaton | None) -> float:
    """Share of the characters that lie in dictionary words."""
    if automaton is None:
        return 0.0
    covered = np.zeros(len(s), dtype=bool)
    for end, n in automaton.iter(s.lower()):
        covered[end - n + 1:end + 1] = True
    return float(covered.mean())


def features(text: str, lo: int, hi: int, path: str, automaton: ahocorasick.Automaton | None) -> list[float]:
    s = text[lo:hi]
    n = len(s)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in s]
    count = Counter(kinds)
    chars = Counter(s)
    entropy = -sum(k / n * math.log2(k / n) for k in chars.values())
    before, after = text[max(0, lo - 48):lo], text[hi:hi + 4]
    line = text.rfind("\n", max(0, lo - 400), lo)
    stripped = before.rstrip("\"' ")
    return [
        float(hi - lo), count["d"] / n, count["l"] / n, count["u"] / n, count["s"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, entropy, len(chars) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)), coverage(s, automaton),
        float(bool(_NAME.search(before))), float(stripped[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'", "`")),
        float(after[:1] in ("\"", "'", "`", ";")), float(before[-1:] in ("@", ".") or after[:1] == "@" or "://" in before),
        float(bool(_PATH.search(path))), float(len(_WORDS.findall(before.lower()))), float(min(lo - max(line, lo - 400), 400)),
    ]


def label_findings(f: np.ndarray) -> np.ndarray:
    """1 a secret, 0 a false positive, -1 unclear; ``f`` holds feature rows."""
    col = {name: f[:, i] for i, name in enumerate(FEATURES)}
    letters = col["lower"] + col["upper"]
    secret = (col["secret_name"] > 0) & (col["digits"] >= 0.1) & (letters >= 0.1) & (col["coverage"] < 0.5)
    # An assigned value of nothing but dictionary words is prose, whatever its name.
    prose = (col["secret_name"] > 0) & (col["coverage"] >= 0.9) & (col["digits"] == 0) & (letters >= 0.9)
    clean = (letters == 0) | (col["coverage"] >= 0.7) | ((col["address"] > 0) & (col["secret_name"] == 0)) | (col["digits"] == 0)
    return np.where(secret, 1, np.where(prose | clean & (col["secret_name"] == 0), 0, -1))


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, str, str]]:
    paths = b.column("path")
    for i, t in enumerate(b.column("text")):
        yield i, t.as_py() or "", paths[i].as_py() or ""


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """About the ``size`` most frequent words of 3 to 12 letters over all documents.

    Words fall into classes of nearly equal counts; whole classes are taken from the top, and of the first one
    that does not fit the words with the smallest hashes.
    """
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
        seen: Counter = Counter()

        def out():
            keep = [(w, n) for w, n in seen.items() if 3 <= len(w) <= 12]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in keep], pa.string()),
                                               pa.array([n for _, n in keep], pa.int64())], names=["word", "n"])
        for b in it:
            for t in b.column(0):
                if t.is_valid:
                    seen.update(t.as_py().encode("utf-8", "surrogatepass").translate(table_).split())
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        yield out()
    counts = cut_lineage(docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word")
                         .agg(F.floor(F.log2(F.sum("n")) * 16).cast("int").alias("class")))
    left, whole, part, share = size, 1 << 30, -1, 0.0
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # a thousand classes at most
        if r["count"] > left:
            part, share = r["class"], left / r["count"]
            break
        left, whole = left - r["count"], r["class"]
    some = (F.col("class") == part) & _under(share, "word")
    return sorted(r["word"] for r in counts.where((F.col("class") >= whole) | some).select("word").collect())


def _place(*columns) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 40))


def _under(share: float, *columns) -> Column:
    """A hash sample of about ``share`` of the distinct values."""
    return _place(*columns) < F.lit(int(share * (1 << 40)))


def labelled_sample(docs: DataFrame, words: list[str], bound: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``bound`` labelled findings, half of each label: those with the smallest hashes.

    Equal findings (copies of a document) have equal features and hashes and count once.
    """
    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = dictionary_automaton(words)
        for b in it:
            x = [features(t, lo, hi, p, a) for _, t, p in _rows(b) for lo, hi in candidates(t)]
            if x:
                y = label_findings(np.array(x))
                keep = np.flatnonzero(y >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.list_(pa.float64())),
                                                  pa.array(y[keep].astype(np.int32))], names=["x", "y"])
    found = cut_lineage(docs.mapInArrow(find, "x array<double>, y int").distinct())
    count = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}  # two rows
    half = bound // 2
    keep = F.lit(False)
    for y, n in count.items():  # a few more than asked for, so that the smallest hashes are among them
        keep = keep | ((F.col("y") == y) & _under(min(1.0, (half + 4 * math.sqrt(half)) / n), "x"))
    rows = [(r["k"], tuple(r["x"]), r["y"]) for r in found.where(keep).select(_place("x").alias("k"), "x", "y").collect()]
    rows = sorted(r[1:] for y in (0, 1) for r in sorted(x for x in rows if x[2] == y)[:half])
    return np.array([x for x, _ in rows]).reshape(-1, len(FEATURES)), np.array([y for _, y in rows], dtype=np.int64)


def train(docs: DataFrame, labelled: tuple[np.ndarray, np.ndarray] | None = None):
    """(dictionary words, forest or None) for ``docs(doc_id, text, path)``."""
    words = dictionary(docs)
    x, y = labelled if labelled is not None else labelled_sample(docs, words)
    return words, RandomForest().fit(x, y) if len(set(y.tolist())) == 2 else None


def scan(docs: DataFrame, model, threshold: float = THRESHOLD, keep: list[str] = ()) -> DataFrame:
    """``docs(doc_id, text, path, keep...)`` -> ``keep...``, spans of all candidates and the redacted text.

    Adds ``findings array<struct<start,length,probability,secret>>`` and ``redacted``.
    """
    words, forest = model
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("probability", pa.float64()), ("secret", pa.bool_())]))
    fields = [docs.schema[c] for c in keep]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = dictionary_automaton(words)
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = list(_rows(part))
                spans = [(i, lo, hi) for i, t, _ in rows for lo, hi in candidates(t)]
                probability = np.empty(0)
                if spans:
                    x = np.array([features(rows[i][1], lo, hi, rows[i][2], a) for i, lo, hi in spans])
                    probability = forest.predict(x) if forest else (label_findings(x) == 1).astype(float)
                found = [[] for _ in rows]
                for (i, lo, hi), p in zip(spans, probability.tolist()):
                    found[i].append({"start": lo, "length": hi - lo, "probability": p, "secret": p >= threshold})
                clean = []
                for (_, t, _), f in zip(rows, found):
                    for x in reversed([x for x in f if x["secret"]]):
                        t = t[:x["start"]] + MASK + t[x["start"] + x["length"]:]
                    clean.append(t)
                valid = part.column("text").is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(found, span),
                     pa.array([t if v else None for t, v in zip(clean, valid)], pa.string())],
                    names=[*keep, "findings", "redacted"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        "findings array<struct<start:bigint,length:bigint,probability:double,secret:boolean>>", "redacted string"])
    return docs.mapInArrow(batches, schema)


def secret_scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` -> per document row: findings and the redacted text."""
    d = docs.select("doc_id", "text", F.col("source").alias("path"))
    return scan(d, train(d), keep=["doc_id"])


def redact(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) with secrets replaced by ``MASK``."""
    path = F.col("source") if "source" in docs.columns else F.lit("")
    d = docs.select("doc_id", "text", path.alias("path"))
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select("text", path.alias("path"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    out = scan(inner, train(d), keep=[f"c{i}" for i in range(len(others))])
    back = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("redacted")}
    return out.select(*[back[c].alias(c) for c in docs.columns])


@register("op8_secret_scans")
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    secrets = F.filter("findings", lambda f: f["secret"])
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"),
                        F.transform(secrets, lambda f: F.struct(f["start"].alias("start"), f["length"].alias("length"))).alias("secrets"),
                        F.sha2("redacted", 256).alias("redacted_sha256"))
