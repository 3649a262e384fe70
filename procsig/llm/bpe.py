"""Byte-level BPE: DuckDB recursive queries inside Spark tasks encode, ordered aggregation decodes.

Each task cuts its texts into pieces with the tokenizer's pattern and encodes the distinct ones that
it has not seen; a piece that is a token stays whole. Any other starts as one row per byte (word,
position, token, next token); a recursive query joins the rows with the merge table and contracts, in
every word and step, the leftmost pair of the smallest rank, until no pair is left. In long words, where
the merged token cannot be part of a token of lower rank, all places of that pair are contracted in the
same step, which gives the same result and keeps very long pieces (a run of one letter) from taking a
step per place.

Rows of a short word stay together from step to step, so neighbours are read without sorting; each row knows
the token behind it, by which the query checks this, and should an engine not keep them together, the same
steps run with sorted windows.

A recursive query keeps the rows of all its steps, so a call is sized by bytes times steps: short words
by the steps they can take at most, long words by a bounded number of steps, whose last rows are fed to
the next call. Between calls long words are cut where no token of the vocabulary holds the bytes of the
two neighbouring tokens: nothing can be merged across, so the parts are words of their own and are
contracted side by side. Words over ``SEGMENT_BYTES`` are cut before the database sees them, where
no token of the vocabulary stands across the place; a part without such a place (one letter, over and over)
is contracted as an array of tokens, the smallest rank of the whole part in each round, until places to
cut appear and the parts are small enough for the database.

Decoding joins token rows with the vocabulary and concatenates the bytes in position order, in parts.

The rank file is a parameter; tasks read it by path, as an installed vocabulary. Memory is bounded
by chunks of texts, blocks of pieces and a cache of encoded pieces that is bounded by number and bytes.

Defined results: NULL and empty texts have no tokens and decode to no bytes; NULL ids and NULL
id arrays decode to no bytes; repeated rows are encoded row by row; an empty table gives an empty
result; other columns are kept out.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES, CACHE_BYTES, ENCODE_ROWS, DECODE_TOKENS, CHUNK_CHARS, LONG_BYTES = 350_000, 32_000_000, 500_000, 500_000, 2_500_000, 32
#: Rows that a recursive query may keep over all its steps; steps of one query over long words.
STEP_ROWS, LONG_STEPS = 3_000_000, 48
#: Bytes of a word that the database takes whole; pieces of one text that are handled at once; memory of the database.
SEGMENT_BYTES, BLOCK_PIECES, MEMORY_MB = 131_072, 500_000, 300

_NONE = np.iinfo(np.int32).max

#: Every split of a token into two tokens; the token's id is its rank. ``safe``: no token of lower
#: rank has the merged token as one of its two parts.
_MERGES = """
CREATE TABLE merges AS
WITH parts AS (SELECT id, hex, unnest(range(1, length(hex) // 2)) AS k FROM vocab),
     pairs AS (SELECT l.id AS l, r.id AS r, p.id AS t FROM parts p
               JOIN vocab l ON l.hex = p.hex[1:2 * k] JOIN vocab r ON r.hex = p.hex[2 * k + 1:]),
     lower AS (SELECT l AS part FROM pairs WHERE l > t UNION SELECT r FROM pairs WHERE r > t)
SELECT l, r, t, t NOT IN (SELECT part FROM lower) AS safe FROM pairs"""

#: A place's ``packed`` value orders places by rank, then from left to right; ``best`` is the
#: word's smallest. Each step contracts it: the place takes the merged token, the next row goes, and the
#: tokens next to them are known without another join. A word without a pair leaves with step -1.
#: ``p`` is the word times 64 plus the position; windows without an order read the rows as they come, and
#: ``apart`` finds a row that is not followed by its word's next.
_STEP = """
WITH RECURSIVE s(p, step, id, nxt) AS (
  SELECT w * 64 + k, 0, id, nxt FROM bytes
  UNION ALL
  (WITH j AS MATERIALIZED (
     SELECT p, step, s.id, nxt, m.t, m.t * 64 + (p & 63) AS packed
     FROM s LEFT JOIN merges m ON m.l = s.id AND m.r = s.nxt WHERE step >= 0),
   b AS (SELECT p >> 6 AS w, min(packed) AS best FROM j GROUP BY p >> 6)
   SELECT p, CASE WHEN apart THEN error('rows out of order') WHEN best IS NULL THEN -1 ELSE step + 1 END,
          CASE WHEN packed = best THEN t ELSE id END,
          CASE WHEN packed = best THEN next_nxt WHEN next_packed = best AND (behind >> 6) = (p >> 6) THEN next_t ELSE nxt END
   FROM (SELECT *, lag(packed) OVER () AS last_packed, lag(p) OVER () AS before, lead(p) OVER () AS behind,
                lead(packed) OVER () AS next_packed, lead(t) OVER () AS next_t, lead(nxt) OVER () AS next_nxt,
                nxt IS NOT NULL AND NOT coalesce(lead(p) OVER () > p AND (lead(p) OVER () >> 6) = (p >> 6) AND lead(id) OVER () = nxt, false) AS apart
         FROM j JOIN b ON b.w = (j.p >> 6))
   WHERE apart OR best IS NULL OR NOT coalesce(last_packed = best AND (before >> 6) = (p >> 6), false)))
SELECT p >> 6 AS w, id FROM s WHERE step = -1 ORDER BY p"""

#: The same steps by sorted windows, for an engine that does not keep the rows in order.
_SORTED_STEP = """
WITH RECURSIVE s(w, step, k, id, nxt) AS (
  SELECT w, 0, k, id, nxt FROM bytes
  UNION ALL
  SELECT w, CASE WHEN best IS NULL THEN -1 ELSE step + 1 END, k, CASE WHEN packed = best THEN t ELSE id END,
         CASE WHEN packed = best THEN next_nxt WHEN next_packed = best THEN next_t ELSE nxt END
  FROM (
    SELECT w, step, k, id, nxt, t, packed, min(packed) OVER (PARTITION BY w) AS best, lag(packed) OVER o AS last_packed,
           lead(packed) OVER o AS next_packed, lead(t) OVER o AS next_t, lead(nxt) OVER o AS next_nxt
    FROM (SELECT w, step, k, s.id, nxt, m.t, CAST(m.t AS BIGINT) * 64 + k AS packed
          FROM s LEFT JOIN merges m ON m.l = s.id AND m.r = s.nxt WHERE step >= 0)
    WINDOW o AS (PARTITION BY w ORDER BY k))
  WHERE best IS NULL OR last_packed IS DISTINCT FROM best)
SELECT w, id FROM s WHERE step = -1 ORDER BY w, k"""

#: The same for long words: where the merged token is safe, every other one of adjoining places of
#: the best rank is contracted in the same step.
_LONG_STEP = """
WITH RECURSIVE s(w, step, k, id) AS (
  SELECT w, 0, k, id FROM bytes
  UNION ALL
  SELECT w, step + 1, CAST(row_number() OVER (PARTITION BY w ORDER BY k) AS INTEGER), id FROM (
    SELECT w, step, k, CASE WHEN take THEN t ELSE id END AS id,
           coalesce(lag(take) OVER (PARTITION BY w ORDER BY k), false) AS gone
    FROM (
      SELECT w, step, k, id, t, coalesce(t = best // 4294967296 AND CASE WHEN safe
               THEN row_number() OVER (PARTITION BY w, t = best // 4294967296, k - place ORDER BY k) % 2 = 1
               ELSE k = best % 4294967296 END, false) AS take
      FROM (
        SELECT *, row_number() OVER (PARTITION BY w, t = best // 4294967296 ORDER BY k) AS place
        FROM (
          SELECT p.w, p.step, p.k, p.id, m.t, m.safe,
                 min(CAST(m.t AS BIGINT) * 4294967296 + p.k) OVER (PARTITION BY p.w) AS best
          FROM (SELECT w, step, k, id, lead(id) OVER (PARTITION BY w ORDER BY k) AS nxt FROM s) p
          LEFT JOIN merges m ON m.l = p.id AND m.r = p.nxt)
        WHERE best IS NOT NULL AND step < {steps})))
  WHERE NOT gone)
SELECT w, k, id, step FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) USING (w, step) ORDER BY w, k"""


def _gather(ids: np.ndarray, starts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces ``code`` one after the other, and how many each has."""
    n = starts[code + 1] - starts[code]
    return ids[np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Engine:
    """An in-process DuckDB database with the vocabulary and merge tables of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        toks = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "tok": pa.array(list(ranks), pa.binary()),
                         "hex": pa.array([t.hex() for t in ranks], pa.string())})
        self.db.register("toks", toks)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM toks")
        self.db.execute(_MERGES)
        self.byte = np.full(256, -1, dtype=np.int32)
        for t, i in ranks.items():
            if len(t) == 1:
                self.byte[t[0]] = i
        self.rank, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.inside: np.ndarray | None = None
        self.codes: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)
        self._turn()

    def _turn(self) -> None:
        """Start a new generation of the cache; pieces of the last one are taken over when met again."""
        self.old = self.codes, self.ids, self.starts
        self.codes, self.ids, self.starts, self.held = {}, np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def _add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.codes.update(zip(pieces, range(len(self.codes), len(self.codes) + len(pieces))))
        self.held += sum(map(len, pieces))

    def _take_over(self, pieces: list[str]) -> None:
        codes, ids, starts = self.old
        code = np.array([codes[p] for p in pieces], dtype=np.int64)
        self._add(pieces, *_gather(ids, starts, code))

    def encode_pieces(self, pieces: list[str]) -> None:
        """Encode unseen pieces into the cache: tokens as they are, the others by merging, short ones first."""
        raw = [p.encode() for p in pieces]
        whole = [i for i, r in enumerate(raw) if r in self.rank]
        self._add([pieces[i] for i in whole], np.array([self.rank[raw[i]] for i in whole], np.int32), np.ones(len(whole), np.int64))
        rest = sorted((r for r in raw if r not in self.rank), key=len)
        for lo, hi, ids, counts in self._merged(rest, SEGMENT_BYTES):
            self._add([r.decode() for r in rest[lo:hi]], ids, counts)

    def _merged(self, raw: list[bytes], limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, flat ids, number of ids of each) of parts of ``raw``, which is sorted by length; words
        over ``limit`` bytes are cut into segments."""
        size = np.array([len(r) for r in raw], dtype=np.int64)
        short, whole = (int(np.searchsorted(size, n, "right")) for n in (LONG_BYTES, limit))
        # A word of n bytes takes n - 1 steps at most, with a row less in each.
        rows = np.cumsum(size * (size + 1) // 2)
        at = 0
        while at < whole:
            to = min(whole, int(np.searchsorted(np.cumsum(size[at:]), ENCODE_ROWS)) + at)
            if at < short:
                to = min(to, short, int(np.searchsorted(rows, rows[at] + STEP_ROWS)))
            to = max(at + 1, to)
            n = size[at:to]
            w = np.repeat(np.arange(to - at, dtype=np.int32), n)
            ids = self.byte[np.frombuffer(b"".join(raw[at:to]), np.uint8)]
            w, ids = self._contract_short(w, ids, n) if at < short else self._contract_long(w, ids)
            yield at, to, ids.astype(np.int32), np.bincount(w, minlength=to - at)
            at = to
        for i in range(whole, len(raw)):
            ids = self._merge_huge(raw[i])
            yield i, i + 1, ids, np.array([len(ids)])

    def _contract_short(self, w: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) rows of the bytes of short words -> those of their tokens."""
        k = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.int32)
        last = np.zeros(len(w), dtype=bool)
        last[np.cumsum(n) - 1] = True
        self.db.register("bytes", pa.table({"w": w, "k": k, "id": ids, "nxt": pa.array(np.r_[ids[1:], ids[:1]], mask=last)}))
        try:
            got = self.db.sql(_STEP).to_arrow_table()
        except duckdb.Error as e:
            if "rows out of order" not in str(e):
                raise
            got = self.db.sql(_SORTED_STEP).to_arrow_table()
        return got.column("w").to_numpy(), got.column("id").to_numpy()

    def _merge_huge(self, word: bytes) -> np.ndarray:
        """Ids of a word that is too long for one call: cut into parts that the database takes."""
        self._prepare()
        data = np.frombuffer(word, np.uint8)
        part = np.cumsum(np.r_[False, self._free(data)], dtype=np.int32)
        size = np.bincount(part)
        ids, out = self.byte[data], []
        end = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + ENCODE_ROWS, "right")))
            rows = slice(int(end[lo] - size[lo]), int(end[hi - 1]))
            if size[lo] > SEGMENT_BYTES:
                hi = lo + 1
                rows = slice(int(end[lo] - size[lo]), int(end[lo]))
                out.append(self._contract_array(ids[rows]))
            else:
                if (size[lo:hi] > SEGMENT_BYTES).any():
                    hi = lo + int(np.argmax(size[lo:hi] > SEGMENT_BYTES))
                    rows = slice(rows.start, int(end[hi - 1]))
                out.append(self._contract_long(part[rows] - part[rows.start], ids[rows])[1])
            lo = hi
        return np.concatenate(out).astype(np.int32)

    def _free(self, data: np.ndarray) -> np.ndarray:
        """Places between neighbouring bytes that no token of the vocabulary can stand across: the two bytes
        are no token, and no token holds them together with the byte before or the byte behind."""
        two = (data[:-1].astype(np.int32) << 8) | data[1:]
        free = ~self.pair_token[two]
        three = (two[:-1] << 8) | data[2:]
        inner = self.triple_inside[three]
        free[1:] &= ~inner
        free[:-1] &= ~inner
        return free

    def _contract_array(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long part: the smallest rank is contracted all over (leftmost place only where its token
        may be part of one of lower rank) until the places to cut leave parts that the database takes."""
        step = 0
        while len(ids) > 1:
            if step % 8 == 0:
                cut = ~self._joinable(ids)
                part = np.cumsum(np.r_[False, cut], dtype=np.int32)
                size = np.bincount(part)
                if size.max() <= SEGMENT_BYTES:
                    out, end, lo = [], np.cumsum(size), 0
                    while lo < len(size):
                        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + ENCODE_ROWS, "right")))
                        rows = slice(int(end[lo] - size[lo]), int(end[hi - 1]))
                        out.append(self._contract_long(part[rows] - part[rows.start], ids[rows])[1])
                        lo = hi
                    return np.concatenate(out)
            step += 1
            t, safe = self._products(ids)
            if t.min() == _NONE:
                break
            best = int(t.min())
            at = np.flatnonzero(t == best)
            if not safe[best]:
                at = at[:1]
            elif len(at) > 1:  # every other one of adjoining places
                run = np.cumsum(np.r_[True, np.diff(at) != 1])
                first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def _products(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each neighbouring pair merges to (``_NONE``: nothing), and which tokens are safe, by id."""
        out = np.empty(len(ids) - 1, dtype=np.int32)
        for lo in range(0, len(out), 1 << 20):
            key = (ids[lo:lo + (1 << 20) + 1][:-1].astype(np.int64) << 32) | ids[lo + 1:lo + (1 << 20) + 1]
            place = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            out[lo:lo + len(key)] = np.where(self.merge_keys[place] == key, self.merge_ids[place], _NONE)
        return out, self.safe

    def _joinable(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self._may_join(ids[lo:lo + (1 << 20) + 1][:-1], ids[lo + 1:lo + (1 << 20) + 1])
                               for lo in range(0, len(ids) - 1, 1 << 20)])

    def _contract_long(self, w: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) rows of long words -> those of their tokens, by calls of a bounded number of steps."""
        self._prepare()
        done_w, done_at, done_id = [], [], []
        at = np.cumsum(self.length[ids]) - self.length[ids]  # the place of each row's first byte, for the order of the result
        while len(w):
            joined = self._may_join(ids[:-1], ids[1:])
            apart = (w[1:] != w[:-1]) | (at[1:] != at[:-1] + self.length[ids[:-1]])  # another word, or done rows between
            part = np.cumsum(np.r_[True, apart | ~joined]) - 1
            n = np.bincount(part)
            alone = n[part] == 1  # one token that nothing can be merged with
            for to, x in ((done_w, w), (done_at, at), (done_id, ids)):
                to.append(x[alone])
            w, at, ids, part = w[~alone], at[~alone], ids[~alone], part[~alone]
            if not len(w):
                break
            n = n[n > 1]
            begin = np.cumsum(n) - n
            part = np.repeat(np.arange(len(n), dtype=np.int32), n)
            k = (np.arange(len(w)) - np.repeat(begin, n) + 1).astype(np.int32)
            steps = int(min(LONG_STEPS, max(1, STEP_ROWS // len(w))))
            self.db.register("bytes", pa.table({"w": part, "k": k, "id": ids.astype(np.int32)}))
            got = self.db.sql(_LONG_STEP.format(steps=steps)).to_arrow_table()
            part, ids, step = (got.column(c).to_numpy() for c in ("w", "id", "step"))
            long = self.length[ids]
            left = np.cumsum(long) - long
            first = np.r_[True, part[1:] != part[:-1]]
            at = at[begin][part] + left - left[first][part]
            w = w[begin][part]
            over = step < steps  # no pair was left before the last step
            for to, x in ((done_w, w), (done_at, at), (done_id, ids)):
                to.append(x[over])
            w, at, ids = w[~over], at[~over], ids[~over]
        w, at, ids = (np.concatenate(x) for x in (done_w, done_at, done_id))
        order = np.argsort(at)
        return w[order], ids[order]

    def _prepare(self) -> None:
        """Tables for long words, made when the first one comes."""
        if self.inside is not None:
            return
        self.inside = np.unique(np.fromiter((hash(t[i:j]) for t in self.tokens.values() for i in range(len(t) - 1)
                                             for j in range(i + 2, len(t) + 1)), dtype=np.int64))
        self.length = np.zeros(max(self.tokens) + 1, dtype=np.int64)
        self.pair_token, self.triple_inside = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 24, dtype=bool)
        for i, t in self.tokens.items():
            self.length[i] = len(t)
            if len(t) == 2:
                self.pair_token[t[0] << 8 | t[1]] = True
            for k in range(len(t) - 2):
                self.triple_inside[t[k] << 16 | t[k + 1] << 8 | t[k + 2]] = True
        got = self.db.sql("SELECT l, r, t, safe FROM merges ORDER BY l, r").to_arrow_table()
        l, r, t, safe = (got.column(c).to_numpy() for c in ("l", "r", "t", "safe"))
        self.merge_keys, self.merge_ids = (l.astype(np.int64) << 32) | r, t.astype(np.int32)
        self.safe = np.zeros(len(self.length), dtype=bool)
        self.safe[t] = safe

    def _may_join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a token of the vocabulary holds the bytes of two neighbours (told by hashes: may be true for more)."""
        pairs, place = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        keys = np.fromiter((hash(self.tokens[x >> 32] + self.tokens[x & 0xFFFFFFFF]) for x in pairs.tolist()), dtype=np.int64, count=len(pairs))
        found = np.searchsorted(self.inside, keys)
        return (self.inside[np.minimum(found, len(self.inside) - 1)] == keys)[place]

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of every text)."""
        flat, per = [np.empty(0, np.int32)], np.zeros(len(texts), dtype=np.int64)
        for every, of in _blocks(texts, pattern):
            fresh = [p for p in dict.fromkeys(every) if p not in self.codes]
            if self.codes and (len(self.codes) + len(fresh) > CACHE_PIECES or self.held > CACHE_BYTES):
                self._turn()
                fresh = list(dict.fromkeys(every))
            self._take_over([p for p in fresh if p in self.old[0]])
            self.encode_pieces([p for p in fresh if p not in self.old[0]])
            code = np.fromiter(map(self.codes.__getitem__, every), dtype=np.int64, count=len(every))
            ids, n = _gather(self.ids, self.starts, code)
            flat.append(ids)
            per += np.bincount(of, n, minlength=len(texts)).astype(np.int64)
        return np.concatenate(flat), per

    def decode_texts(self, flat: np.ndarray, per: np.ndarray) -> list[bytes]:
        """The bytes of every text: token rows joined with the vocabulary, aggregated in position order; a long
        text in several parts."""
        out: list[list[bytes]] = [[] for _ in range(len(per))]
        doc = np.repeat(np.arange(len(per), dtype=np.int32), per)
        for lo in range(0, len(flat), DECODE_TOKENS):
            part = flat[lo:lo + DECODE_TOKENS]
            self.db.register("tokens", pa.table({"doc": doc[lo:lo + DECODE_TOKENS], "pos": np.arange(len(part), dtype=np.int32), "id": part}))
            got = self.db.sql("SELECT doc, list(tok ORDER BY pos) AS toks FROM tokens JOIN vocab USING (id) "
                              "GROUP BY doc ORDER BY doc").to_arrow_table()
            for docs, toks in zip(got.column("doc").chunks, got.column("toks").chunks):
                for i, d in enumerate(docs.to_pylist()):
                    out[d].append(_joined(toks, i))
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def _blocks(texts: list[str | None], pattern: regex.Pattern) -> Iterator[tuple[list[str], np.ndarray]]:
    """(pieces, text number of each) of at most ``BLOCK_PIECES`` pieces or one shorter text."""
    every: list[str] = []
    numbers, counts = [], []

    def block() -> tuple[list[str], np.ndarray]:
        nonlocal every, numbers, counts
        out = every, np.repeat(np.array(numbers, dtype=np.int64), counts)
        every, numbers, counts = [], [], []
        return out
    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) <= CHUNK_CHARS:
            parts = iter([pattern.findall(t)])
        else:
            found = (m.group() for m in pattern.finditer(t))
            parts = iter(lambda: list(itertools.islice(found, BLOCK_PIECES)), [])
        for pieces in parts:
            if every and len(every) + len(pieces) > BLOCK_PIECES:
                yield block()
            every += pieces
            numbers.append(i)
            counts.append(len(pieces))
    if every:
        yield block()


@functools.lru_cache(maxsize=2)
def engine(path: str) -> Engine:
    """One engine per Python worker and rank file; the worker keeps it for later tasks."""
    return Engine(path)


def _chunked(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    """(ids, texts) of parts of a batch; only one part's texts are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK_CHARS)))
        yield b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo).to_pylist()
        lo = hi


def _id_lists(flat: np.ndarray, per: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, ids array<int>`` (as the rank file's own library encodes)."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eng, pat = engine(path), regex.compile(pattern)
        for b in it:
            for doc_ids, texts in _chunked(b):
                yield pa.RecordBatch.from_arrays([doc_ids, _id_lists(*eng.encode(texts, pat))], names=["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "doc_id bigint, ids array<int>")


def _joined(lists: pa.ListArray, i: int) -> bytes:
    """The bytes of list ``i``: its values lie next to each other in one buffer."""
    child = lists.values
    o = np.frombuffer(child.buffers()[1], dtype=np.int32)[child.offset:]
    lo, hi = lists.offsets[i].as_py(), lists.offsets[i + 1].as_py()
    return child.buffers()[2][int(o[lo]):int(o[hi])].to_pybytes() if hi > lo else b""


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded binary`` to ``encoded(doc_id, ids)``."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eng = engine(path)
        for b in it:
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64)
            flat = b.column(1).flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)  # a NULL id stands for no bytes
            per = np.bincount(np.repeat(np.arange(len(size)), size)[known], minlength=len(size))
            ids = flat.drop_null().to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(eng.decode_texts(ids, per), pa.binary())],
                                             names=["doc_id", "ids", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(batches, "doc_id bigint, ids array<int>, decoded binary")


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, ids, decoded``: both directions in one task, whose worker
    holds one engine and gives the memory of its last texts back when the task ends."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eng, pat = engine(path), regex.compile(pattern)
        for b in it:
            for doc_ids, texts in _chunked(b):
                flat, per = eng.encode(texts, pat)
                del texts
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, _id_lists(flat, per), pa.array(eng.decode_texts(flat, per), pa.binary())], names=["doc_id", "ids", "decoded"])
        pa.default_memory_pool().release_unused()
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "doc_id bigint, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids and digest of the decoded bytes."""
    return encode_decode(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
