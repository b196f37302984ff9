"""Vectorised word hashing for one Arrow batch of texts (runs inside tasks).

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D).
All words of a batch are hashed together: with prefix sums of ``byte * P**i``
modulo 2**64, a word's polynomial hash is a difference of two prefix sums
times ``P**-start`` (P is odd, so it has an inverse).  No per-word Python runs.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), so that related inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S33)) * _M1
        h = (h ^ (h >> _S33)) * _M2
        return h ^ (h >> _S33)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        with np.errstate(over="ignore"):
            for base in (_P, _P_INV):
                x = np.full(_BLOCK + 1, base, dtype=np.uint64)
                x[0] = 1
                _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words in a byte buffer."""
    word = np.zeros(len(buf) + 2, dtype=np.int8)
    word[1:-1] = ~_WHITE[buf]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_block(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers()
    with np.errstate(over="ignore"):
        pre = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=pre[1:])
        return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): hash of every word; text i has ``hashes[offsets[i]:offsets[i+1]]``.

    Works block by block (256 KiB of text, so that work arrays stay in cache; cut between texts; a longer
    text is cut between words), so memory beside the output stays bounded.
    """
    out, counts = [np.empty(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    block, size, first = [], 0, 0

    def flush(last: int) -> None:
        data = b"\n".join(block)
        buf = np.frombuffer(data, dtype=np.uint8)
        start, end = word_bounds(buf)
        cuts = np.cumsum([len(b) + 1 for b in block])
        counts[first:last] = np.diff(np.searchsorted(start, cuts), prepend=0)
        lo = 0
        while lo < len(start):
            hi = max(int(np.searchsorted(end, start[lo] + _BLOCK, side="right")), lo + 1)
            at, to = int(start[lo]), int(end[hi - 1])
            if to - at > _BLOCK:                     # one word longer than a block
                out.append(mix(np.array([_long_word(data[at:to])], dtype=np.uint64)))
            else:
                out.append(_hash_block(buf[at:to], start[lo:hi] - at, end[lo:hi] - at))
            lo = hi

    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if block and size + len(b) + 1 > _BLOCK:
            flush(i)
            block, size, first = [], 0, i
        block.append(b)
        size += len(b) + 1
    if block:
        flush(len(texts))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def _long_word(b: bytes) -> int:
    import hashlib
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (fewer words: none)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    p = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        g = h[:n].copy()
        for j in range(1, size):
            g *= p
            g += h[j:n + j]
        return mix(g)


def ragged(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and text index of each ``size``-run that stays inside its text."""
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[:-1][doc] + within, doc
