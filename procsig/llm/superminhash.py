"""SuperMinHash signatures of many sets at once.

Every element draws, from its own hash, a random permutation of the signature slots, one place
per level, and a random fraction per level; slot ``p[j]`` receives ``j + fraction``. A slot keeps
its smallest value. Because an element's slots are all different, the signature's variance is below
that of independent minima. Level ``j`` can only lower slots whose value is ``j`` or more, so a set
stops at the first level above its largest slot value (the early stop).
"""

from __future__ import annotations

import numpy as np

from procsig.llm.wordhash import mix

SLOTS = 256
_STEP_INT = 0x9E3779B97F4A7C15
_STEP = np.uint64(_STEP_INT)
_CHUNK = 8192


def _draw(h: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    z = mix(h + np.uint64((2 * level + 1) * _STEP_INT % 2 ** 64))
    k = level + (((mix(z + _STEP) >> np.uint64(32)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53, k


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots); an empty set keeps infinity in every slot."""
    sig = np.full((len(sets), slots), np.inf)
    if not len(sets):
        return sig
    flat = sig.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets) if len(owner) else np.empty(0, dtype=np.uint64)
    frac, k = _draw(h, 0, slots)
    np.minimum.at(flat, owner * slots + k, frac)
    short = np.flatnonzero((sig.max(axis=1) >= 1) & (sizes > 0))
    short = short[np.argsort(sizes[short], kind="stable")]  # sets of one size need about as many levels
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts[short] - (np.cumsum(sizes[short]) - sizes[short]), sizes[short]) + np.arange(sizes[short].sum())
    plain = np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32)
    for at in range(0, len(left), _CHUNK):
        rows = left[at:at + _CHUNK]
        own, hh, p0 = owner[rows], h[rows], k[rows]
        line, perm = np.arange(len(rows)), np.broadcast_to(plain, (len(rows), slots)).copy()
        perm[line, p0], perm[line, 0] = 0, p0
        docs = own[np.r_[True, own[1:] != own[:-1]]]
        for level in range(1, slots):
            open_ = sig[docs].max(axis=1) >= level
            if not open_.all():
                docs = docs[open_]
                if not len(docs):
                    break
                on = np.zeros(len(sets), dtype=bool)
                on[docs] = True
                keep = on[own]
                own, hh, line = own[keep], hh[keep], line[keep]
            frac, kk = _draw(hh, level, slots)
            slot = perm[line, kk]
            perm[line, kk] = perm[line, level]
            perm[line, level] = slot
            np.minimum.at(flat, own * slots + slot, frac + level)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band (the band's number is part of the key)."""
    bits = mix(sig[:, :bands * rows].view(np.uint64)).reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        acc = mix(acc * _STEP + bits[:, :, r])
    return acc.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits per slot, 32 slots to a word: equal slots agree, others agree by chance in 1 of 4."""
    two = mix(sig.view(np.uint64)) & np.uint64(3)
    two = two.reshape(len(sig), -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(two, axis=2).view(np.int64)
