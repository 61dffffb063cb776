"""Words of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_LIMIT = 200_000
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words met before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word: A-Z lower-cased, split at the six ASCII white-space characters (bytes.lower and bytes.split do just that)."""
    words = text.encode().lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct runs of width words; of all words if they are fewer; none without words."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    k = min(width, n)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = mixed(s * _M + h[i : n - k + 1 + i])
    return np.unique(s)


def pack48(h: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, six bytes each, in the same order."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data) -> np.ndarray:
    """What pack48 wrote, as numbers below 2**48."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()
