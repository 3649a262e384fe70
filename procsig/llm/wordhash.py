"""Words and word shingles of whole texts as 64-bit hashes (NumPy, inside Spark tasks).

Many texts are hashed at once: their UTF-8 bytes are laid end to end, word borders come from a
byte class table, and a word's hash is the sum of one random number per (place, byte).
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xFF51AFD7ED558CCD)]
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_NUMBERS = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _MUL[0])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text); A-Z count as a-z."""
    _, hashes, _, per_text = words_of(texts)
    return hashes, per_text


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, hash and first byte of every word, words per text); A-Z count as a-z."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer((b" ".join(raw) + b" ").lower(), dtype=np.uint8)
    parts = [_hash_words(data[lo:hi], lo) for lo, hi in _segments(data, 1 << 18)]  # within a core's cache
    begins = np.concatenate([p[1] for p in parts])
    return data, np.concatenate([p[0] for p in parts]), begins, np.diff(
        np.searchsorted(begins, np.r_[0, np.cumsum([len(r) + 1 for r in raw])]))


def spaced_words(data: np.ndarray, begins: np.ndarray) -> str:
    """The words that begin at these bytes, in this order, a space before each."""
    space = np.flatnonzero(_SPACE[data])
    size = space[np.searchsorted(space, begins)] - begins + 1
    first = np.cumsum(size) - size
    out = data[np.repeat(begins - 1 - first, size) + np.arange(size.sum())]
    out[first] = 0x20
    return out.tobytes().decode("utf-8", "surrogatepass")


def _segments(data: np.ndarray, size: int = 1 << 22):
    """Ranges that end behind a space, so that a very long text needs no more memory than others."""
    lo = 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data) and not _SPACE[data[hi - 1]]:
            hi += 1
        yield lo, hi
        lo = hi


def _hash_words(data: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words in a range."""
    inner = np.flatnonzero(~_SPACE[data])
    if not len(inner):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    new = np.empty(len(inner), dtype=bool)
    new[0] = True
    np.not_equal(np.diff(inner), 1, out=new[1:])
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(inner)])
    place = np.arange(len(inner)) - np.repeat(first, size)
    value = _NUMBERS[((place & (_PLACES - 1)) << 8) + data[inner]]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] *= (2 * (place[far] >> 6) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64)), inner[first] + offset


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    w, counts = word_hashes(texts)
    n = len(w) - size + 1
    if n > 0:
        acc = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            acc = (acc ^ (acc >> np.uint64(29))) * _MUL[i] + w[i:i + n]
        acc = mix(acc)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            s = np.sort(acc[at:at + c - size + 1])
            fresh = np.empty(len(s), dtype=bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        elif c:
            one = np.array([c], dtype=np.uint64)
            for i in range(c):
                one = (one ^ (one >> np.uint64(29))) * _MUL[i] + w[at + i]
            out.append(mix(one))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += c
    return out


def text_chunks(texts, max_chars: int = 1_000_000, max_texts: int = 512):
    """Ranges (start, end) over ``texts`` of at most ``max_chars`` characters or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (size + n > max_chars or i - start >= max_texts):
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)
