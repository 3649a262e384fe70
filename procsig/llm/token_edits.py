"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A document is cut into pre-tokens (the tokenizer's pattern) that lie in blocks; a segment tree holds
every block's characters and tokens, so a place is found and a sum updated in logarithmic time. An
edit re-encodes only the pre-tokens it touches plus boundary context: matching restarts at the
pre-token that holds the character two before the edit (a match depends on at most two characters
behind its end) and stops where a new match ends on an old border behind the edit, from where the
old pre-tokens stay as they are.

Documents and their edits meet on ``doc_id`` by one shuffle and are read as a sorted stream: a
document first, then its edits in order, so a document with very many edits needs no more memory
than its text. Documents without a ``doc_id`` cannot be addressed and are counted where they are.

Defined results: NULL and empty texts have no tokens and can be edited; ``start`` is clipped to the
text (NULL: its end), NULL or negative ``n_delete`` deletes nothing, NULL ``insert`` inserts nothing;
edits apply in order of (seq, start, n_delete, insert); edits without a document are ignored; rows
that repeat a ``doc_id`` are separate documents that all get its edits; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK, MAX_BLOCK, CACHE_PIECES = 128, 512, 300_000
#: A match depends on the characters up to this many behind its end.
CONTEXT = 2


class PieceCounts(dict):
    """pre-token -> number of tokens; remembers a bounded number of pre-tokens."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        # Every piece is one match already, so the pattern takes it whole.
        self.encoding = tiktoken.Encoding("counts", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


class TokenTree:
    """Pre-token blocks of one text under a segment tree of (characters, tokens)."""

    def __init__(self, text: str, pattern: regex.Pattern, counts: PieceCounts):
        self.pattern, self.counts = pattern, counts
        self.reencoded = 0
        self._build(pattern.findall(text) if text else [])

    def _build(self, pieces: list[str]) -> None:
        self.blocks = [pieces[i:i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.size = 1
        while self.size < len(self.blocks):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, b in enumerate(self.blocks):
            self.chars[self.size + i] = sum(map(len, b))
            self.tokens[self.size + i] = sum(map(self.counts.__getitem__, b))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _set(self, block: int, pieces: list[str]) -> None:
        self.blocks[block] = pieces
        i = self.size + block
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(map(self.counts.__getitem__, pieces))
        i //= 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def _find(self, pos: int) -> tuple[int, int, int]:
        """(block, piece in it, first character of the piece) of the piece that holds ``pos``."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if pos >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        block = min(i - self.size, len(self.blocks) - 1)
        for k, p in enumerate(self.blocks[block]):
            if pos < before + len(p):
                return block, k, before
            before += len(p)
        return block, len(self.blocks[block]), before

    def _pieces_from(self, block: int, k: int) -> Iterator[tuple[int, int, str]]:
        while block < len(self.blocks):
            for j in range(k, len(self.blocks[block])):
                yield block, j, self.blocks[block][j]
            block, k = block + 1, 0

    def edit(self, start: int | None, n_delete: int | None, insert: str | None) -> None:
        n = self.n_chars
        start = n if start is None else min(max(start, 0), n)
        end = min(start + max(n_delete or 0, 0), n)
        if end == start and not insert:
            return
        b0, k0, first = self._find(max(start - CONTEXT, 0))
        window, at, old = "", first, self._pieces_from(b0, k0)
        borders: dict[int, tuple[int, int]] = {}   # place in the window -> old piece that starts there
        parts, open_end = [], True
        while at < end or (at < start):            # old pieces that the edit touches
            block, k, p = next(old)
            parts.append(p)
            at += len(p)
        left = "".join(parts)
        window = left[:start - first] + (insert or "") + left[end - first:] if end - first <= len(left) else left
        new, pos, done, ahead = [], 0, None, 8
        while done is None:
            grown = []
            for _ in range(ahead):
                nxt = next(old, None)
                if nxt is None:
                    open_end = False
                    break
                borders[len(window) + sum(map(len, grown))] = (nxt[0], nxt[1])
                grown.append(nxt[2])
            window += "".join(grown)
            ahead *= 2
            while pos < len(window):
                if pos in borders:
                    done = borders[pos]
                    break
                m = self.pattern.match(window, pos)
                if open_end and m.end() + CONTEXT > len(window):
                    break                          # the match may change with more text
                new.append(m.group())
                pos = m.end()
            if done is None and not open_end:
                if pos < len(window):
                    continue
                done = (len(self.blocks), 0)
        self.reencoded += len(new)
        self._splice(b0, k0, done, new)

    def _splice(self, b0: int, k0: int, to: tuple[int, int], new: list[str]) -> None:
        b1, k1 = to
        tail = self.blocks[b1][k1:] if b1 < len(self.blocks) else []
        head = self.blocks[b0][:k0]
        joined = head + new + tail
        if len(joined) > MAX_BLOCK:
            rest = [p for b in self.blocks[b1 + 1:] for p in b]
            self._build([p for b in self.blocks[:b0] for p in b] + joined + rest)
            return
        self._set(b0, joined)
        for b in range(b0 + 1, min(b1, len(self.blocks) - 1) + 1):
            self._set(b, [])


def _result(doc_id, tree: TokenTree, before: int, n_edits: int) -> tuple:
    return doc_id, before, tree.n_tokens, tree.n_chars, n_edits, tree.reencoded


_OUT = pa.schema([("doc_id", pa.int64()), ("tokens_before", pa.int64()), ("tokens_after", pa.int64()),
                  ("chars_after", pa.int64()), ("n_edits", pa.int64()), ("pieces_reencoded", pa.int64())])
_OUT_SQL = ("doc_id bigint, tokens_before bigint, tokens_after bigint, chars_after bigint, n_edits bigint, "
            "pieces_reencoded bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_OUT)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def edited_counts(docs: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)``, ``edits(doc_id, seq, start, n_delete, insert)`` -> counts per document row."""
    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pat = piece_counts(path), regex.compile(pattern)
        current, trees, n_edits, out = None, [], 0, []

        def close():
            out.extend(_result(current, t, before, n_edits) for t, before in trees)

        for b in it:
            names = ("doc_id", "kind", "start", "n_delete", "text")
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for doc_id, kind, start, n_delete, text in zip(*(part.column(c).to_pylist() for c in names)):
                    if doc_id != current:
                        close()
                        current, trees, n_edits = doc_id, [], 0
                    if kind == 0:
                        tree = TokenTree(text or "", pat, counts)
                        trees.append((tree, tree.n_tokens))
                    else:
                        n_edits += 1
                        for tree, _ in trees:
                            tree.edit(start, n_delete, text)
                if len(out) > 1000:
                    yield _batch(out)
                    out = []
        close()
        yield _batch(out)

    def plain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pat = piece_counts(path), regex.compile(pattern)
        for b in it:
            out = []
            for t in b.column("text"):
                n = sum(map(counts.__getitem__, pat.findall(t.as_py() or "")))
                out.append((None, n, n, len(t.as_py() or ""), 0, 0))
            yield _batch(out)

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("seq"),
                    F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("n_delete"), "text")
    e = edits.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint"), F.lit(1), F.col("seq").cast("bigint"), F.col("start").cast("bigint"),
        F.col("n_delete").cast("bigint"), F.col("insert").alias("text"))
    order = ["doc_id", "kind", "seq", "start", "n_delete", "text"]
    both = (d.where("doc_id IS NOT NULL").unionByName(e.toDF(*d.columns))
            .repartition("doc_id").sortWithinPartitions(*order))
    return both.mapInArrow(stream, _OUT_SQL).unionByName(
        d.where("doc_id IS NULL").select("text").mapInArrow(plain, _OUT_SQL))


def derived_edits(docs: DataFrame) -> DataFrame:
    """Five edits per document, derived from its own content: places from hashes of its id, inserted
    text from its source, language and first characters."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1)
    src, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    edit = lambda k, start, n_delete, insert: F.struct(
        F.lit(k).cast("bigint").alias("seq"), start.cast("bigint").alias("start"),
        F.lit(n_delete).cast("bigint").alias("n_delete"), insert.alias("insert"))
    head = F.substring(F.coalesce("text", F.lit("")), 1, 25)
    all_ = F.array(edit(1, at(1), 0, F.concat(F.lit(" "), src, F.lit(" "))), edit(2, at(2), 12, F.concat(lang, F.lit("'s"))),
                   edit(3, at(3), 30, F.lit("")), edit(4, at(4), 1, F.concat(F.lit("\n\n"), head)),
                   edit(5, F.lit(0), 3, F.concat(F.lit("  "), lang)))
    return docs.select("doc_id", F.explode(all_).alias("e")).select("doc_id", "e.*")


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return edited_counts(docs, derived_edits(docs), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
