"""CRC-32 of many byte ranges and of their concatenations at once (NumPy).

The checksum without its fixed start and end is linear over XOR: a byte contributes a table value
that depends on its distance from the end, and appending n bytes shifts what was there by n zero
bytes. So the checksums of word runs follow from those of the words, without joining strings.
"""

from __future__ import annotations

import zlib

import numpy as np

from procsig.llm.bytewords import spread

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
_NEAR = 64


def _base() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_BASE = _base()


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _BASE[c & 0xFF] ^ (c >> np.uint32(8))


def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``_SHIFT[n][j][b]``: byte b at place j of a register, n zero bytes later; ``_AT[d][b]``: byte b with d
    bytes behind it; shifts by 64, 128, ... bytes."""
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    shift, at, byte = [], [], _BASE
    for _ in range(_NEAR):
        shift.append(now)
        at.append(byte)
        now, byte = _zero_byte(now), _zero_byte(byte)
    powers = [now]
    for _ in range(32):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(shift), np.stack(at), powers


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (table[0][c & 0xFF] ^ table[1][(c >> np.uint32(8)) & 0xFF] ^ table[2][(c >> np.uint32(16)) & 0xFF]
            ^ table[3][c >> np.uint32(24)])


_SHIFT, _AT, _POWERS = _tables()
_FLAT = _SHIFT.reshape(-1)
_START = np.array([zlib.crc32(bytes(n)) for n in range(1024)], dtype=np.uint32)


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers ``c`` after ``n`` zero bytes."""
    at = (n & (_NEAR - 1)) << 10
    out = (_FLAT[at + (c & 0xFF)] ^ _FLAT[at + 256 + ((c >> np.uint32(8)) & 0xFF)]
           ^ _FLAT[at + 512 + ((c >> np.uint32(16)) & 0xFF)] ^ _FLAT[at + 768 + (c >> np.uint32(24))])
    far = np.flatnonzero(n >= _NEAR)
    if len(far):
        high = n[far] >> 6
        value = out[far]
        for k in range(int(high.max()).bit_length()):
            value = np.where((high >> k) & 1, _apply(_POWERS[k], value), value)
        out[far] = value
    return out


def raw(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The linear part of the checksum of every (non-empty) range."""
    if not len(start):
        return np.empty(0, np.uint32)
    at, behind, first = spread(start, size)
    if int(size.max()) <= _NEAR:
        return np.bitwise_xor.reduceat(_AT[behind, data[at]], first)
    out = np.bitwise_xor.reduceat(_AT[np.minimum(behind, _NEAR - 1), data[at]], first)
    for i in np.flatnonzero(size > _NEAR).tolist():
        n = int(size[i])
        out[i] = zlib.crc32(data[start[i]:start[i] + n].tobytes()) ^ int(start_value(np.array([n]))[0])
    return out


def start_value(n: np.ndarray) -> np.ndarray:
    """What turns the linear part of an n-byte range into its CRC-32: the checksum of n zero bytes."""
    out = _START[np.minimum(n, len(_START) - 1)]
    far = np.flatnonzero(n >= len(_START))
    if len(far):
        # n zero bytes: the all-ones register, shifted, inverted.
        ones = np.full(len(far), 0xFFFFFFFF, dtype=np.uint32)
        out[far] = shifted(ones, n[far]) ^ np.uint32(0xFFFFFFFF)
    return out
