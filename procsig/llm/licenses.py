"""License scans: Aho-Corasick over notice phrases and identifier tags, shunting-yard expressions.

A text is normalised to its words (ASCII lower case) with single spaces, so a phrase is found where
its words stand consecutively whatever stands between them. One automaton holds all phrases and the
``spdx license identifier`` tag. Behind a tag, the expression of the raw text is read by a
shunting-yard parser (``WITH`` binds tighter than ``AND``, ``AND`` tighter than ``OR``, parentheses)
and its identifiers become labels; it also says whether the text may be used under the allowed
identifiers alone (an ``AND`` needs both sides, an ``OR`` one).

Defined results: NULL and empty texts have no words, no labels and score 0; overlapping phrases all
count; a tag without a readable expression adds no label; repeated rows are scanned row by row;
other columns are ignored. Memory is bounded by one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.sources.tables import table

#: The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices that the method labels.
MORE_PHRASES = {
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd", "bsd 3 clause": "bsd", "bsd 2 clause": "bsd",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "creative commons zero": "cc0", "eclipse public license": "epl",
    "all rights reserved": "all-rights-reserved", "public domain": "public-domain",
}
TAG = "spdx license identifier"
#: Labels under which text may be used without further terms.
ALLOWED = frozenset({"mit", "apache-2", "bsd", "cc0", "public-domain"})

#: UTF-8 bytes: A-Z in lower case, other ASCII but letters and digits as a space.
_LOWER_BREAK = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TAG_IN_TEXT = re.compile(r"(?i)spdx[^A-Za-z0-9]+license[^A-Za-z0-9]+identifier[^A-Za-z0-9(\n]*([^\n]*)")
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.\-]*\+?)")
_RANK = {"or": 1, "and": 2, "with": 3}


def normal_label(identifier: str) -> str:
    """``Apache-2.0`` -> ``apache-2``, ``GPL-3.0-or-later`` -> ``gpl``, ``BSD-3-Clause`` -> ``bsd``."""
    x = identifier.lower().rstrip("+")
    for family in ("lgpl", "agpl", "gpl", "mpl", "bsd", "epl", "cc0"):
        if x.startswith(family):
            return family
    x = re.sub(r"-(\d+)(?:\.\d+)*$", r"-\1", x)
    return re.sub(r"-\d+$", "", x) if x.startswith("cc-") else x


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the longest readable expression at the start, in postfix order ([] if none).

    Words that follow without an operator end the expression; unclosed operators are dropped.
    """
    out: list[str] = []
    ops: list[str] = []
    operand = False  # whether the last token was an operand or a closing parenthesis
    at = 0
    while m := _TOKEN.match(expression, at):
        tok = m.group(1)
        low = tok.lower()
        if tok == "(":
            if operand:
                break
            ops.append(tok)
        elif tok == ")":
            if not operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif low in _RANK:
            if not operand:
                break
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        else:
            if operand:
                break
            out.append(tok)
            operand = True
        at = m.end()
    if not operand and ops:
        while ops and ops[-1] == "(":
            ops.pop()
        if ops:
            ops.pop()  # an operator without its right side
    out += [o for o in reversed(ops) if o != "("]
    return out


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[set[str], bool]:
    """(labels, usable under the allowed labels alone) of a postfix expression."""
    stack: list[tuple[set[str], bool]] = []
    for tok in postfix:
        if tok in _RANK:
            if len(stack) < 2:
                return set(), False
            (rl, ro), (ll, lo) = stack.pop(), stack.pop()
            if tok == "with":  # the right side is an exception: it names no licence and takes no right away
                stack.append((ll, lo))
            else:
                stack.append((ll | rl, (lo and ro) if tok == "and" else (lo or ro)))
        else:
            x = normal_label(tok)
            stack.append(({x}, x in allowed))
    return stack[-1] if len(stack) == 1 else (set(), False)


def build_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for base, phrases in ((True, BASE_PHRASES), (False, MORE_PHRASES)):
        for p, label in phrases.items():
            a.add_word(f" {p} ", (len(p.split()), label, base))
    a.add_word(f" {TAG} ", (3, "", False))
    a.make_automaton()
    return a


def scan_text(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    """``(n_words, n_base, first_word, last_word, spans, base_labels, labels, score)``.

    ``spans`` are ``(start, words, label)`` of every phrase place. The score is 1 for a text that is
    usable under the allowed labels, 0.5 if only some of its terms are, 0 without any allowed term.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER_BREAK).split() if text else []
    spans, tagged, base = [], False, []
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    at = counted = 0
    for end, (n, label, is_base) in automaton.iter(joined):
        counted += joined.count(" ", at, end)  # spaces before the closing one: words up to the phrase's last
        at = end
        start = counted - n
        if not label:
            tagged = True
            continue
        spans.append((start, n, label))
        if is_base:
            base.append((start, label))
    found = [(label, label in ALLOWED) for _, _, label in spans]
    labels = {label for label, _ in found}
    terms = [ok for _, ok in found]
    if tagged:
        for m in _TAG_IN_TEXT.finditer(text):
            names, ok = evaluate(to_postfix(m.group(1)))
            if names:
                labels |= names
                terms.append(ok)
    score = 0.0 if not any(terms) else 1.0 if all(terms) else 0.5
    starts = [s for s, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), spans,
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                     ("last_word", pa.int64()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))),
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = build_automaton()
    for b in batches:
        rows = [(i, *scan_text(t.as_py(), automaton)) for i, t in zip(b.column(0).to_pylist(), b.column(1))]
        cols = list(zip(*rows)) or [()] * len(_SCHEMA)
        cols[5] = [[{"start": s, "words": n, "label": x} for s, n, x in spans] for spans in cols[5]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def license_scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per document row with spans, labels and score."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _scan_batches, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                       "spans array<struct<start:bigint,words:bigint,label:string>>, base_labels string, labels string, score double")


@register("op6_license_scans")
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
