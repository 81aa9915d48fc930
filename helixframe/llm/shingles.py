"""Word shingles of texts as sorted 64-bit hashes, in numpy.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A word's hash is multilinear in its bytes
with 64-bit coefficients; two different shingles of the texts compared share one with a chance below 2**-56.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _coefficients(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64(salt)) | np.uint64(1)


_BY_PLACE = _coefficients(64, 1)


def _block_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and where they start."""
    global _BY_PLACE
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    if (longest := int(sizes.max())) > len(_BY_PLACE):
        _BY_PLACE = _coefficients(2 * longest, 1)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    value = (b[word].astype(np.uint64) + np.uint64(1)) * _BY_PLACE[place]
    return _mix(np.add.reduceat(value, first) + sizes.astype(np.uint64)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One hash a word and the words' starts; long data go in blocks cut at white space, so memory stays small."""
    b = np.frombuffer(data.lower(), np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(b):
        stop = min(len(b), at + BLOCK)
        while stop < len(b) and not (cut := np.flatnonzero(_SPACE[b[stop : stop + 4096]])).size:
            stop = min(len(b), stop + 4096)
        stop = stop if stop == len(b) else stop + int(cut[0])
        h, s = _block_hashes(b[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; a text of fewer words has one, without words none."""
    hashes, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, ends)
    factor = _coefficients(max(words, 1), 2)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += hashes[j : j + n] * factor[j]
    rolled = _mix(rolled)
    out, at = [], 0
    for stop in cuts.tolist():
        if stop - at >= words:
            out.append(np.unique(rolled[at : stop - words + 1]))
        elif stop > at:
            out.append(_mix((hashes[at:stop] * factor[: stop - at]).sum(keepdims=True) + np.uint64(stop - at)))
        else:
            out.append(np.zeros(0, np.uint64))
        at = stop
    return out


class MinHash:
    """Signatures by linear permutations of 32-bit shingle hashes; 16 bits of each minimum are kept."""

    def __init__(self, size: int, seed: int = 7):
        self.factors = (_coefficients(size, 1000 + seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 1024):
            np.minimum(low, np.multiply.outer(x[a : a + 1024], self.factors).min(0), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
