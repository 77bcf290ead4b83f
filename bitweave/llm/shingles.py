"""Word shingles of whole texts as sorted fingerprints of 48 or 32 bits, many texts at once in numpy."""

from __future__ import annotations

import numpy as np

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32
_BASE = 0x9E3779B97F4A7C15 | 3
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the power of 0, 1, ... n and of 0, -1, ... -n, modulo 2**64."""
    if len(_powers[0]) <= n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(texts: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles (48 bits in uint64, ascending within a text) and each text's number of them.

    At most 65,535 texts at once. Words are runs of letters and digits, in lower case; bytes beyond ASCII count as letters. A text of fewer than k
    words has one shingle of them all; one without a word has none.
    """
    raw = [t.lower().encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = _FOLD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    n = len(buf)
    word = buf != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    owner_at = np.searchsorted(start, np.cumsum(size + 1) - (size + 1))
    words = np.diff(np.r_[owner_at, len(start)])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    doc = np.repeat(np.arange(len(raw)), words)
    s = h.copy()
    for j in range(1, k):
        s[:-j] = s[:-j] * np.uint64(0x9FB21C651E98DF25) + h[j:]
    s = mix(s)
    left = np.repeat(owner_at + words, words) - np.arange(len(start))  # words from here to the text's end
    keep = left >= k
    few = np.flatnonzero((words > 0) & (words < k))
    for d in few:
        a, b = owner_at[d], owner_at[d] + words[d]
        v = np.uint64(7)
        for x in h[a:b]:
            v = np.uint64((int(v) * 0x9FB21C651E98DF25 + int(x)) & (2**64 - 1))
        s[a] = mix(np.array([v]))[0]
        keep[a] = True
    key = np.sort((doc[keep].astype(np.uint64) << np.uint64(48)) | (s[keep] >> np.uint64(16)))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return key & np.uint64((1 << 48) - 1), np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(raw))


def narrow(prints: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as 32-bit fingerprints, distinct within a text."""
    doc, s = np.repeat(np.arange(len(n)), n), (prints >> np.uint64(16)).astype(np.uint32)
    new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])][: len(s)]
    return s[new], np.bincount(doc[new], minlength=len(n))


def shingle_sets(texts: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fingerprints` of 32 bits."""
    return narrow(*fingerprints(texts, k))


def minhash(sets: np.ndarray, n: np.ndarray, perms: int, seed: int = 5) -> np.ndarray:
    """[texts, perms] smallest hash of each text's shingles; texts without a shingle get the largest number."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**31, perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, perms, dtype=np.uint32)
    out = np.full((len(n), perms), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        for j in range(perms):
            v = (sets ^ add[j]) * mul[j]
            v ^= v >> np.uint32(15)
            out[some, j] = np.minimum.reduceat(v, first)
    return out
