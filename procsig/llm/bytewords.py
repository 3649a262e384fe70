"""Words of whole Arrow string columns as byte ranges (NumPy, inside Spark tasks).

The UTF-8 buffer of a column is read in segments that end between two words, so memory follows the
segment (or one word), not the text. No Python string is made per text or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 21

#: ASCII letters, digits and all non-ASCII bytes; the same without digits.
ALNUM = np.array([not (b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
ALPHA = ALNUM & ~np.array([0x30 <= b <= 0x39 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """Words of one segment: ``data`` in ASCII lower case, places in it, and each word's text."""
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    if column.null_count:
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if (size != np.diff(offsets)).any():
            return string_buffers(column.fill_null(""))
    return data, offsets


def words(column: pa.Array, inside: np.ndarray = ALNUM, segment: int = SEGMENT) -> Iterator[Words]:
    """The words (runs of ``inside`` bytes within one text) of the column, segment by segment, in order."""
    data, offsets = string_buffers(column)
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + segment, end)
        while hi < end and inside[data[hi - 1]]:
            ahead = np.flatnonzero(~inside[data[hi:hi + 4096]])
            hi = hi + int(ahead[0]) + 1 if len(ahead) else min(hi + 4096, end)
        part = LOWER[data[lo:hi]]
        at = np.flatnonzero(inside[part])
        if len(at):
            first_text = int(np.searchsorted(offsets, lo, "right")) - 1
            last_text = int(np.searchsorted(offsets, hi, "left"))
            new = np.empty(len(at), dtype=bool)
            new[0] = True
            np.not_equal(np.diff(at), 1, out=new[1:])
            # A text may begin in the middle of a run of word bytes.
            begins = offsets[first_text + 1:last_text] - lo
            place = np.searchsorted(at, begins)
            hit = place < len(at)
            place = place[hit]
            new[place[at[place] == begins[hit]]] = True
            first = np.flatnonzero(new)
            start = at[first]
            size = np.diff(np.r_[first, len(at)])
            text = np.searchsorted(offsets, start + lo, "right") - 1
            yield Words(part, start, size, text)
        lo = hi


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of every byte of the ranges, its place from the range's end, first byte index of each range)."""
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.repeat(start, size) + inner, np.repeat(size, size) - 1 - inner, first
