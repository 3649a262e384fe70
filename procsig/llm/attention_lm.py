"""LM scoring: a causal self-attention model over subword ids, trained in NumPy, scored in Spark.

The model
  Text is a sequence of words (ASCII lower case) and one end. A word's subword ids come from a
  public tokenizer; every id has a class (clusters of ids by the documents they occur in, so that
  a class tells language and topic). One causal self-attention layer with relative position biases
  predicts the class of the next id from the classes before it; an id's share of its class comes
  from counts over all training documents. A word is then scored as a mixture, under the class of its
  first id, of the word as a whole (counts of all words) and of its ids one by one:
  ``p(class | context) * (w * p(word | class) + (1 - w) * p(first id | class) * p(further ids))``.

Training gathers from the whole corpus. Counts of all words and of all subword ids come from all training
documents (shuffles that grow with the input). Classes and attention are learnt from every training text,
whole: Spark adds up, for every id, the random projections of the texts it occurs in (its place), and
k-means groups the places; every task then trains the attention layer over all windows of all its texts, and
the layers of all tasks are averaged by their windows. The driver holds one place per id of the tokenizer
and one layer. Only the values that training starts from come from a bounded number of texts
(``WARM_TEXTS``, ``WARM_CHARS``).

Scoring cuts every text into windows of ``WINDOW`` ids that overlap by ``OVERLAP``: each id is scored
once, in the first window where it has its context; windows are scored in batches under one causal
mask. The base score's rare words are looked up by a shuffle on the word's hash; only the ``FREQUENT``
most frequent words go to the tasks, a bounded table. The same look-up gives the model's score the counts
of all other words, so that every trained word counts whatever the number of distinct words.

Defined results: NULL and empty texts are one end token; a NULL ``doc_id`` counts as the empty text in
the checksum; repeated rows are separate documents; an empty table gives an empty result; without
training documents every count is 0 and the model falls back to uniform shares; other columns are
ignored. Words are told apart by 64-bit hashes. Memory is bounded by chunks of texts and one text.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.llm.wordhash import spaced_words, text_chunks, words_of
from procsig.session import cut_lineage
from procsig.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
FREQUENT = 262_144
WARM_TEXTS, WARM_CHARS, PLACE, TUNE_RATE = 3000, 2_000, 8, 0.003
CLASSES, DIM, WINDOW, OVERLAP, STEPS, BATCH = 64, 16, 32, 8, 600, 64
WORD_SHARE = 0.8
END = np.uint64(0)  # the end token's hash among word hashes


class _Numbers:
    """hash -> running number from 1, as an array with open addressing; ``END`` is number 0."""

    def __init__(self, slots: int = 1 << 16):
        self.size, self.mask = 1, np.uint64(slots - 1)
        self.keys, self.codes = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int64)

    def __len__(self) -> int:
        return self.size

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for those not met so far."""
        at = (h & self.mask).view(np.int64)
        key, code = self.keys.take(at), self.codes.take(at)
        left = np.flatnonzero(key != h)
        while len(left):
            free = key.take(left) == END
            code[left[free]] = -1
            left = left[~free]
            at[left] = (at[left] + 1) & int(self.mask)
            key[left] = self.keys[at[left]]
            code[left] = self.codes[at[left]]
            left = left[key[left] != h[left]]
        return code

    def add(self, h: np.ndarray) -> None:
        """Numbers distinct new hashes in their order."""
        if 2 * (self.size + len(h)) > len(self.keys):
            old = self.keys != END
            keys, codes, size = self.keys[old], self.codes[old], self.size
            self.__init__(1 << (2 * (size + len(h))).bit_length())
            self._put(keys, codes)
            self.size = size
        self._put(h, np.arange(self.size, self.size + len(h)))
        self.size += len(h)

    def _put(self, h: np.ndarray, code: np.ndarray) -> None:
        at = (h & self.mask).view(np.int64)
        while len(h):
            free = self.keys[at] == END
            self.keys[at[free]], self.codes[at[free]] = h[free], code[free]  # of several for one slot, the last in both
            left = self.keys[at] != h
            h, code, at = h[left], code[left], (at[left] + 1) & int(self.mask)


class Subwords:
    """Words as numbers with their subword ids (as of a word after a space) and hashes.

    Words are found by their hashes, new ones are spelled in one call. Remembers a bounded number of words; whatever
    is asked per word is an array look-up.
    """

    def __init__(self, path: str, pattern: str, limit: int = 400_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding("lm", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size, self.limit = max(ranks.values()) + 2, limit  # the last id is the end
        self.starts = np.zeros(self.size, dtype=bool)
        for t, i in ranks.items():
            self.starts[i] = t[:1] == b" "
        self._clear()

    def _clear(self) -> None:
        self.codes = _Numbers()
        self.ids, self.first = np.array([self.size - 1], dtype=np.int32), np.array([0, 1])
        self.hashes = np.array([END], dtype=np.uint64)
        self.times = np.zeros(1, dtype=np.int64)  # how often each word came since the last clearing
        self.counts, self.counts_of = np.empty(0, dtype=np.int64), None

    def make_room(self) -> None:
        """Forgets the words that came once, and the rarer ones beyond half the limit; all numbers change."""
        least = 2
        if len(self.times) > self.limit // 2:
            least = max(least, 1 + int(np.partition(self.times, -self.limit // 2)[-self.limit // 2]))
        kept = 1 + np.flatnonzero(self.times[1:] >= least)
        ids, n = self.spell(kept)
        hashes = self.hashes[kept]
        self._clear()
        self._remember(hashes, ids, n)
        self.times[1:] = 1

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        self.codes.add(hashes)
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.times = np.concatenate([self.times, np.zeros(len(hashes), dtype=np.int64)])

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, words per text); every text closes with the end."""
        if len(self.codes) > self.limit:
            self.make_room()
        data, hashes, begins, per_text = words_of(texts)
        found = self.codes.find(hashes)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            new, at = np.unique(hashes[fresh], return_index=True)
            self._remember(new, *self._encode(spaced_words(data, begins[fresh[at]])))
            found[fresh] = self.codes.find(hashes[fresh])
        self.times += np.bincount(found, minlength=len(self.times))
        per_text = per_text + 1
        inner = np.ones(len(found) + len(texts), dtype=bool)
        inner[np.cumsum(per_text) - 1] = False
        code = np.zeros(len(inner), dtype=np.int64)
        code[inner] = found
        return code, per_text

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids per word) of words with a space before each, every word as if alone."""
        words = text[1:].split(" ")
        if len(text.split()) == len(words):  # no other white space: no piece of the pattern goes over a space
            ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int32)
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(words) and not first[0]:
                return ids, np.diff(np.r_[first, len(ids)])
        if len(words) > 1:
            half = len(words) // 2
            parts = [self._encode("".join(" " + w for w in x)) for x in (words[:half], words[half:])]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int32)
        return ids, np.array([len(ids)])

    def spell(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(subword ids of the words one after the other, ids per word)."""
        n = self.first[code + 1] - self.first[code]
        return self.ids[np.repeat(self.first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def count(self, code: np.ndarray, model: Model) -> np.ndarray:
        """Training counts of the frequent words, 0 for all others, which a shuffle looks up later."""
        if self.counts_of != model.key:
            self.counts, self.counts_of = np.empty(0, dtype=np.int64), model.key
        if len(self.counts) < len(self.hashes):
            self.counts = np.concatenate([self.counts, frequent_counts(model, self.hashes[len(self.counts):])])
        return self.counts[code]


@functools.lru_cache(maxsize=1)
def subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


def _signs(size: int, seed: int = 11) -> np.ndarray:
    """The random projection: a row of ``PLACE`` signs for every id."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), (size, PLACE))


def id_places(train: DataFrame, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of every id, sum over them of their text's projection) over all of ``train(text)``."""
    return gathered_places(corpus_counts(train, path, pattern).where("id IS NOT NULL"), subwords(path, pattern).size)


def gathered_places(id_rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, projections) of all ids as arrays, from ``id_rows(id, n, v)``: one row per id of the tokenizer at most."""
    n, total = np.zeros(size, np.int64), np.zeros((size, PLACE))
    for r in id_rows.select("id", "n", "v").collect():
        n[r["id"]], total[r["id"]] = r["n"], r["v"]
    return n, total


def id_classes(counts: np.ndarray, total: np.ndarray, starts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Class of every id: k-means over the mean projection of the texts it occurs in, apart for ids that begin a word.

    Ids without an occurrence share one class each for beginnings and for the rest; the end id has its own.
    """
    n_ids = len(starts)
    rng = np.random.default_rng(seed)
    place = total / np.maximum(counts, 1)[:, None]
    place -= np.average(place, axis=0, weights=np.maximum(counts, 1e-9))
    place *= (counts / (counts + 5.0))[:, None]  # rare ids lean to the middle
    out = np.where(starts, 0, 1)
    first = 3
    for kind, k in ((True, (CLASSES - 3) // 2), (False, CLASSES - 3 - (CLASSES - 3) // 2)):
        ids = np.flatnonzero((starts == kind) & (counts > 0))
        if not len(ids):
            continue
        k = min(k, len(ids))
        w = counts[ids].astype(float)
        x = place[ids]
        centers = x[rng.choice(len(ids), size=k, replace=False, p=w / w.sum())]
        for _ in range(20):
            near = ((centers ** 2).sum(axis=1)[None] - 2 * x @ centers.T).argmin(axis=1)
            for c in range(k):
                if (near == c).any():
                    centers[c] = np.average(x[near == c], axis=0, weights=w[near == c])
        out[ids] = first + near
        first += k
    out[n_ids - 1] = 2
    return out.astype(np.int32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _exponentials(w: np.ndarray, h: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(``exp(w @ h)``, its sums by column); exponents are held within 60 where a sum shows that one may pass it."""
    with np.errstate(over="ignore"):
        y = np.matmul(w, h, out=out)
        every = np.exp(y, out=y).sum(axis=0)
    if every.size and not (every.min() > 1e-15 and every.max() < 1e26):
        y = np.clip(np.matmul(w, h, out=out), -60, 60)
        every = np.exp(y, out=y).sum(axis=0)
    return y, every


class Attention:
    """``h = E[c] + softmax(Q K' / sqrt(d) + b[i - j]) V O``, ``p(next class) = softmax(h W + a)``."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / math.sqrt(DIM), s)
        self.p = {"E": g(CLASSES, DIM), "Q": g(DIM, DIM), "K": g(DIM, DIM), "V": g(DIM, DIM), "O": g(DIM, DIM),
                  "b": np.zeros(WINDOW), "W": g(DIM, CLASSES), "a": np.zeros(CLASSES)}
        i = np.arange(WINDOW)
        self.lag = np.maximum(i[:, None] - i[None, :], 0)
        self.mask = np.where(i[:, None] >= i[None, :], 0.0, -1e9)
        self.spot = np.arange(CLASSES * (DIM + 1)).reshape(CLASSES, DIM + 1)
        self.work: dict[str, np.ndarray] = {}

    def _buffer(self, name: str, shape: tuple, dtype: np.dtype) -> np.ndarray:
        """A work array that stays from step to step."""
        x = self.work.get(name)
        if x is None or x.shape != shape or x.dtype != dtype:
            x = self.work[name] = np.zeros(shape, dtype)
        return x

    def loss(self, c: np.ndarray, target: np.ndarray, valued: bool = True) -> tuple[float | None, dict]:
        """Mean negative log-likelihood over windows ``c -> target`` (None unless ``valued``) and its gradient.

        Inputs are classes, so queries, keys and values are tables by class: attention looks its weights up by pairs
        of classes (``V O`` goes into the values), and gradients are summed by class or pair before they go through
        the matrices. Attention weights stay unscaled: their sum is one more column of the values. Exponents are
        held as in ``tables``.
        """
        p, scale, (m, l), n, kind = self.p, 1 / math.sqrt(DIM), c.shape, c.size, self.p["E"].dtype
        buf = lambda name, *shape: self._buffer(name, shape, kind)
        flat = c.ravel()
        q, k, w = p["E"] @ p["Q"] * kind.type(scale), p["E"] @ p["K"], p["E"] @ p["V"]
        v = np.ones((CLASSES, DIM + 1), kind)
        v[:, :DIM] = w @ p["O"]
        v = v.take(flat, axis=0).reshape(m, l, DIM + 1)
        pair = np.add((c * CLASSES)[:, :, None], c[:, None, :], out=self._buffer("pair", (m, l, l), np.dtype(np.int64)))
        att = np.exp(np.clip(q @ k.T, -30, 30)).ravel().take(pair, out=buf("att", m, l, l), mode="clip")
        att *= (np.exp(np.clip(p["b"], -30, 30))[self.lag] * (self.mask == 0)).astype(kind)
        mixed = np.matmul(att, v, out=buf("mixed", m, l, DIM + 1)).reshape(n, DIM + 1)
        total = np.repeat(mixed[:, DIM], DIM + 1).reshape(n, DIM + 1)
        mixed /= total  # the last column becomes 1, the head's constant
        h = np.c_[p["E"], np.zeros(CLASSES, kind)].take(flat, axis=0)
        h += mixed
        dy, every = _exponentials(np.vstack([p["W"], p["a"]]).T, h.T, buf("y", CLASSES, n))  # a column per place
        at = target.ravel() * n + np.arange(n)
        value = float(-np.log(dy.take(at) / every + 1e-30).sum() / n) if valued else None
        dy /= every * n
        dy.reshape(-1)[at] -= 1 / n
        head = (dy @ h).T
        g = {"W": head[:DIM], "a": head[DIM]}
        dh = dy.T @ np.vstack([p["W"], np.zeros(CLASSES, kind)]).T
        by = dh / total
        by[:, DIM] = (by * mixed) @ np.full(DIM + 1, -1, kind)
        by = by.reshape(m, l, DIM + 1)
        dv = np.matmul(att.transpose(0, 2, 1), by, out=buf("dv", m, l, DIM + 1)).reshape(n, DIM + 1)
        ds = np.matmul(by, v.transpose(0, 2, 1), out=buf("ds", m, l, l))
        ds *= att
        g["b"] = np.bincount(self.lag.ravel(), weights=ds.sum(axis=0).ravel(), minlength=WINDOW)
        ds = np.bincount(pair.ravel(), weights=ds.ravel(), minlength=CLASSES ** 2).reshape(CLASSES, CLASSES).astype(kind)
        spot = self.spot.take(flat, axis=0).ravel()
        de, dv = (np.bincount(spot, weights=x.ravel(), minlength=self.spot.size).reshape(self.spot.shape)[:, :DIM].astype(kind)
                  for x in (dh, dv))
        dq, dk, dw = ds @ k * kind.type(scale), ds.T @ q, dv @ p["O"].T
        for name, d in (("Q", dq), ("K", dk), ("V", dw)):
            g[name] = p["E"].T @ d
        g["O"] = w.T @ dv
        g["E"] = de + dq @ p["Q"].T + dk @ p["K"].T + dw @ p["V"].T
        return value, g

    def fit(self, classes: np.ndarray, steps: int = STEPS, seed: int = 9) -> Attention:
        """Adam on random windows of one long class sequence."""
        if len(classes) <= WINDOW + 1:
            return self
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.p["a"] = np.log(np.bincount(classes, minlength=CLASSES) + 1.0) - math.log(len(classes) + CLASSES)
        for t in range(1, steps + 1):
            at = rng.integers(0, len(classes) - WINDOW, BATCH)[:, None] + np.arange(WINDOW)
            _, g = self.loss(classes[at], classes[at + 1], valued=False)
            self._step(g, m, s, t, 0.02 * min(1.0, t / 50) * (1 - 0.9 * t / steps))
        return self

    def _step(self, g: dict, m: dict, s: dict, t: int, rate: float, p: dict | None = None) -> None:
        p = self.p if p is None else p
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)

    def tuned(self, parts: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
        """(parameters in one row, windows) after a pass, in single precision, over all windows of class sequences, one
        behind the other; the rate falls with the steps, so that the mean over tasks settles. What is left of a
        sequence goes before the next one; the last window of all reaches back over places already seen."""
        names = sorted(self.p)
        flat = self.row().astype(np.float32)  # all parameters in one row; ``self.p`` looks into it
        cuts = np.cumsum([self.p[k].size for k in names])[:-1]
        self.p = {k: x.reshape(self.p[k].shape) for k, x in zip(names, np.split(flat, cuts))}
        m, s = {"all": np.zeros_like(flat)}, {"all": np.zeros_like(flat)}
        seen = t = 0

        def step(x: np.ndarray) -> None:
            nonlocal t, seen
            t, seen = t + 1, seen + len(x)
            _, g = self.loss(x[:, :-1], x[:, 1:], valued=False)
            g = {"all": np.concatenate([g[k].ravel() for k in names]).astype(np.float32)}
            self._step(g, m, s, t, TUNE_RATE / math.sqrt(1 + t / 50), {"all": flat})
        held = np.empty((0, WINDOW + 1), dtype=np.int64)
        rest = last = np.empty(0, dtype=np.int64)
        for c in parts:
            c = np.concatenate([rest, c])
            n = max(0, (len(c) - 1) // WINDOW)
            if n:
                windows = np.lib.stride_tricks.sliding_window_view(c, WINDOW + 1)[:(n - 1) * WINDOW + 1:WINDOW]
                held = np.concatenate([held, windows])
                whole = len(held) // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    step(held[at:at + BATCH])
                held = held[whole:]
                last = c[(n - 1) * WINDOW:n * WINDOW]
            rest = c[n * WINDOW:]
        if len(rest) > 1 and len(last):
            held = np.concatenate([held, np.concatenate([last, rest])[None, -WINDOW - 1:]])
        for at in range(0, len(held), BATCH):
            step(held[at:at + BATCH])
        return self.row().astype(float), seen

    def row(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def from_row(self, row: np.ndarray) -> Attention:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k], at = row[at:at + n].reshape(self.p[k].shape).copy(), at + n
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """Inference tables over classes: weights of pairs and of lags, values with a column of ones (the sum of the
        weights), inputs and head. Exponents are held within what single precision can sum."""
        p = self.p
        lag = np.exp(np.clip(p["b"][self.lag], -30, 30)) * (self.mask == 0)
        value = np.c_[p["E"] @ p["V"] @ p["O"], np.ones(CLASSES)]
        pair = np.exp(np.clip(p["E"] @ p["Q"] @ (p["E"] @ p["K"]).T / math.sqrt(DIM), -30, 30)).ravel()
        return {k: np.ascontiguousarray(v, dtype=np.float32) for k, v in
                {"pair": pair, "lag": lag, "value": value, "input": np.c_[p["E"], np.zeros(CLASSES)], "head": np.vstack([p["W"], p["a"]])}.items()}


def class_scores(classes: np.ndarray, per_text: np.ndarray, t: dict[str, np.ndarray], batch: int = 64) -> np.ndarray:
    """log p(class | classes before it in its text) for every place; texts begin in the end class.

    Windows hold the inputs; consecutive windows of a text overlap by ``OVERLAP`` places, whose
    predictions were scored by the window before and are not computed again.
    """
    out = np.empty(len(classes), dtype=np.float64)
    stride = WINDOW - OVERLAP
    ends = np.cumsum(per_text)
    begins = ends - per_text
    more = np.maximum(0, -(-(per_text - WINDOW) // stride))  # windows behind the first
    text = np.repeat(np.arange(len(per_text)), more)
    number = np.arange(len(text)) - np.repeat(np.cumsum(more) - more, more) + 1
    inputs = np.empty(len(classes), dtype=np.int64)
    inputs[1:] = classes[:-1]
    inputs[begins] = 2
    for new, start, end in ((0, begins, ends), (OVERLAP, begins[text] + number * stride, ends[text])):
        att = np.empty((batch, WINDOW - new, WINDOW), dtype=np.float32)
        pair = np.empty(att.shape, dtype=np.int64)
        y = np.empty((CLASSES, batch * (WINDOW - new)), dtype=np.float32)
        for lo in range(0, len(start), batch):
            at = start[lo:lo + batch, None] + np.arange(WINDOW)
            n = len(at)
            c = inputs.take(at, mode="clip")
            np.add((c[:, new:] * CLASSES)[:, :, None], c[:, None, :], out=pair[:n])
            s = t["pair"].take(pair[:n], out=att[:n], mode="clip")
            s *= t["lag"][new:]
            mixed = (s @ t["value"].take(c, axis=0)).reshape(-1, DIM + 1)
            mixed /= np.repeat(mixed[:, DIM], DIM + 1).reshape(mixed.shape)  # the last column becomes 1, the head's constant
            mixed += t["input"].take(c[:, new:].ravel(), axis=0)
            x, every = _exponentials(t["head"].T, mixed.T, y if n == batch else None)  # a column per place
            place = at[:, new:].ravel()
            picked = x.take(classes.take(place, mode="clip") * np.int64(len(mixed)) + np.arange(len(mixed)))
            score = np.log(np.maximum(picked, math.exp(-60))) - np.log(every)
            inside = place < np.repeat(end[lo:lo + batch], WINDOW - new)
            out[place[inside]] = score[inside]
    return out


@dataclass
class Model:
    classes: np.ndarray          # class of every id
    log_share: np.ndarray        # log p(id | class)
    class_total: np.ndarray      # counts of words by the class of their first id
    tables: dict[str, np.ndarray]
    words: np.ndarray            # hashes of the frequent words, sorted
    counts: np.ndarray           # their counts in the training documents

    @property
    def key(self) -> tuple[int, int, int]:
        return len(self.words), int(self.words.sum()), int(self.counts.sum())


def frequent_counts(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Counts of the frequent words among ``hashes``, 0 for all others."""
    if not len(model.words):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
    return np.where(model.words[at] == hashes, model.counts[at], 0)


def score_words(model: Model, sub: Subwords, code: np.ndarray, per_text: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of every text, gain of every word); ``count``: training counts of its words, 0 if not known.

    A word scored with count 0 whose count is ``c`` adds ``ln(1 + c * exp(gain))`` to the natural logarithm.
    """
    flat, per_word = sub.spell(code)
    first = np.cumsum(per_word) - per_word
    texts = np.cumsum(per_text) - per_text
    cls = model.classes[flat]
    log_class = class_scores(cls, np.add.reduceat(per_word, texts), model.tables)
    # Ids one by one: everything but the first id's class, which both ways have in common.
    rest = np.add.reduceat(log_class + model.log_share[flat], first) - log_class[first]
    total = np.maximum(model.class_total[cls[first]], 1)
    mixed = np.logaddexp(np.log(np.maximum(count / total, 1e-300)) + math.log(WORD_SHARE), rest + math.log(1 - WORD_SHARE))
    return np.add.reduceat(log_class[first] + mixed, texts) / math.log(10), math.log(WORD_SHARE) - np.log(total) - mixed


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


class _Tally:
    """Of every word (by its number): how often it came, and the sum of its texts' projections."""

    def __init__(self, sub: Subwords):
        self.sub, self.signs = sub, _signs(sub.size)
        self.times, self.total, self.of_word = np.zeros(0, np.int64), np.zeros((PLACE, 0)), np.zeros((0, PLACE), np.float32)

    def add(self, texts: list[str | None]) -> None:
        code, per_text = self.sub.read(texts)
        more = len(self.sub.codes) - len(self.times)
        if more:
            flat, n = self.sub.spell(np.arange(len(self.times), len(self.sub.codes)))
            self.of_word = np.concatenate([self.of_word, np.add.reduceat(self.signs[flat], np.cumsum(n) - n, axis=0)])
            self.times = np.concatenate([self.times, np.zeros(more, np.int64)])
            self.total = np.concatenate([self.total, np.zeros((PLACE, more))], axis=1)
        first = np.cumsum(per_text) - per_text
        ids = np.add.reduceat(np.diff(self.sub.first)[code], first)
        mean = np.add.reduceat(self.of_word[code], first, axis=0) / ids[:, None]
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
        mean[[not t for t in texts]] = 0  # texts without content have no place
        self.times += np.bincount(code, minlength=len(self.times))
        for j in range(PLACE):
            self.total[j] += np.bincount(code, weights=np.repeat(mean[:, j], per_text), minlength=len(self.times))

    def rows(self) -> Iterator[pa.RecordBatch]:
        code = np.flatnonzero(self.times)
        ids, per_word = self.sub.spell(code)
        n, *total = (np.bincount(ids, weights=np.repeat(x[code], per_word), minlength=self.sub.size) for x in (self.times, *self.total))
        at = np.flatnonzero(n)
        word, none = np.r_[np.ones(len(code), bool), np.zeros(len(at), bool)], np.zeros(len(code))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[none.astype(np.int64), at], mask=word), pa.array(np.r_[self.sub.hashes[code].view(np.int64), at], mask=~word),
             pa.array(np.r_[self.times[code], n[at].astype(np.int64)]), *(pa.array(np.r_[none, x[at]], mask=word) for x in total)],
            names=["id", "h", "n", *_PLACES])


_PLACES = [f"p{j}" for j in range(PLACE)]


def corpus_counts(train: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(id, h, n, v)`` over all of ``train(text)``: counts of words by hash (``id`` NULL) and of subword ids
    (``h`` NULL) with the sum of their texts' projections (``v``), from one pass; every text adds one end. A task
    adds up its words as long as the tokenizer remembers them."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, pattern)
        tally = _Tally(sub)
        for b in it:
            texts = b.column(0).to_pylist()
            for lo, hi in text_chunks(texts, max_chars=4_000_000, max_texts=100_000):
                if len(sub.codes) > sub.limit:  # numbers are given anew
                    yield from tally.rows()
                    sub.make_room()
                    tally = _Tally(sub)
                tally.add(texts[lo:hi])
        yield from tally.rows()
    sums = [F.sum(c).alias(c) for c in _PLACES]
    return (train.select("text").mapInArrow(count, "id bigint, h bigint, n bigint, " + ", ".join(f"{c} double" for c in _PLACES))
            .groupBy("id", "h").agg(F.sum("n").alias("n"), *sums).select("id", "h", "n", F.when(F.col("id").isNotNull(), F.array(*_PLACES)).alias("v")))


def frequent_words(counts: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of at most ``bound`` words: all whose count reaches a threshold.

    The threshold comes from a histogram of counts on a logarithmic scale, a table of bounded size.
    """
    words = counts.where(F.col("h") != int(END))
    scale = F.floor(F.log2("c") * 32).cast("int")
    keep, least = 0, None
    for r in sorted(words.groupBy(scale.alias("s")).count().collect(), key=lambda r: -r["s"]):
        if keep + r["count"] > bound:
            break
        keep, least = keep + r["count"], r["s"]
    if least is None:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    rows = words.where(scale >= least).toPandas()
    h = rows["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy(dtype=np.int64)[order]


def warm_texts(parts: DataFrame, n: int, size: int) -> list[str]:
    """The beginnings of about ``size`` of ``n`` texts, chosen by their hash."""
    share = min(1.0, size / max(n, 1))
    rows = parts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(F.left(F.col("text"), F.lit(WARM_CHARS)).alias("text"))
    return sorted(r["text"] for r in rows.collect())


def tune(parts: DataFrame, warm: Attention, classes: np.ndarray, path: str, pattern: str) -> Attention:
    """The mean of the layers that every task gets from ``warm`` over all windows of all its texts, by their number."""
    start = warm.row()

    def go_on(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, pattern)

        def sequences() -> Iterator[np.ndarray]:
            for b in it:
                texts = b.column(0).to_pylist()
                for lo, hi in text_chunks(texts):
                    yield classes[sub.spell(sub.read(texts[lo:hi])[0])[0]]
        row, seen = Attention().from_row(start).tuned(sequences())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([row], pa.list_(pa.float64()))], names=["seen", "row"])
    mean = (parts.select("text").mapInArrow(go_on, "seen double, row array<double>")
            .groupBy(F.lit(0).alias("all")).agg(Summarizer.mean(array_to_vector("row"), F.col("seen")).alias("m")).first())
    return Attention().from_row(mean["m"].toArray()) if mean else warm


def train_model(train: DataFrame, words: DataFrame, id_rows: DataFrame, path: str, pattern: str,
                warm_size: int = WARM_TEXTS, steps: int = STEPS) -> Model:
    """Fit on ``train(doc_id, text)``; ``words(h, c)`` and ``id_rows(id, n, v)`` are its counts."""
    sub = subwords(path, pattern)
    parts = train.select("text").where("text <> ''")
    found, total = gathered_places(id_rows, sub.size)
    n_texts = parts.count()
    seen = found.copy()
    seen[-1] = n_texts  # ends of texts without content have no place
    classes = id_classes(seen, total, sub.starts)
    flat = sub.spell(sub.read(warm_texts(parts, n_texts, warm_size) or [""])[0])[0]
    attention = tune(parts, Attention().fit(classes[flat], steps), classes, path, pattern)
    n = found + 1.0
    share = np.log(n / np.bincount(classes, weights=n, minlength=CLASSES)[classes])
    # All words of a class, by their first ids; the end is a word of its own class.
    opens = sub.starts.copy()
    opens[-1] = True
    total = np.bincount(classes[opens], weights=(n - 1)[opens], minlength=CLASSES)
    hashes, counts = frequent_words(words, FREQUENT)
    return Model(classes, share, total, attention.tables(), hashes, counts)


def lm_scores(docs: DataFrame, path: str, pattern: str, warm_size: int = WARM_TEXTS, steps: int = STEPS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    d = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    train = d.where("NOT held_out")
    both = cut_lineage(corpus_counts(train, path, pattern))
    counts = both.where("id IS NULL").select("h", F.col("n").alias("c"))
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, vocabulary = int(size["n"] or 0), int(size["v"])
    model = train_model(train, counts, both.where("id IS NOT NULL"), path, pattern, warm_size, steps)
    ends = counts.where(F.col("h") == int(END)).first()
    end_count = int(ends["c"]) if ends else 0

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, pattern)
        for b in it:
            texts = b.column("text").to_pylist()
            for lo, hi in text_chunks(texts):
                part = b.slice(lo, hi - lo)
                code, n = sub.read(texts[lo:hi])
                c = sub.count(code, model)
                s, gain = score_words(model, sub, code, n, c)
                h = sub.hashes[code]
                known = c > 0
                doc = np.repeat(np.arange(len(n)), n)
                c[h == END] = end_count
                seen = np.bincount(doc, weights=c > 0, minlength=len(n)).astype(np.int64)
                logs = np.bincount(doc, weights=np.log10(c + 1.0), minlength=len(n))
                rare = ~known & (h != END)
                rd, rh = doc[rare], h[rare]
                order = np.lexsort((rh, rd))
                rd, rh, gain = rd[order], rh[order], gain[rare][order]
                new = np.r_[True, (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])] if len(rd) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                gains = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rd)].astype(np.int32)), pa.array(gain))
                off = np.r_[0, np.cumsum(np.bincount(rd[first], minlength=len(n)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(seen), pa.array(logs),
                     pa.array(s), pa.ListArray.from_arrays(pa.array(off), pa.array(rh[first].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(off), gains)],
                    names=["row_id", "doc_id", "held_out", "n_tokens", "seen", "logs", "score", "rare", "gains"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut_lineage(d.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(
        score, f"row_id bigint, doc_id {kind}, held_out boolean, n_tokens bigint, seen bigint, logs double, score double, "
               "rare array<bigint>, gains array<array<double>>"))
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare", "gains")).alias("z")).select(
        "row_id", F.col("z.rare").alias("h"), F.col("z.gains").alias("gains"))
    # One row per place of a found word; words without a count leave before that.
    places = rare.join(counts, "h").select("row_id", "c", F.explode("gains").alias("gain"))
    found = places.groupBy("row_id").agg(
        F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"),
        (F.sum(F.log1p(F.col("c") * F.exp("gain"))) / math.log(10)).alias("more_score"))
    floor = math.log10(n_train + vocabulary + 1)
    return (scored.drop("rare", "gains").join(found, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")))


@register("op3_lm_scores")
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
