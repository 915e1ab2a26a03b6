"""Numpy kernels on word hashes: rolling hashes, minimizers, shingle sets.

Words are split at the six ASCII white-space bytes (what ``bytes.split()`` does) and hashed
to 64 bits; the kernels work on one long array for a whole batch of documents.
"""

from __future__ import annotations

import numpy as np
import xxhash

ONE = np.uint64(1)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: odd multipliers of the polynomial hashes (two lanes) and their inverses modulo 2**64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASES[0]) + h[j:j + n]
    return mix64(out)


def sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (np.minimum or np.maximum) over every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = fold(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return fold(x[:len(x) - rest], x[rest:]) if rest else x


class Polynomial:
    """Hashes of any word range of one array in O(1): two lanes of prefix sums modulo 2**64."""

    def __init__(self, h: np.ndarray, lanes: int = 1):
        self.lanes = []
        for lane in range(lanes):
            base = BASES[lane]
            power = np.full(len(h) + 1, np.uint64(base))
            power[0] = ONE
            power = np.multiply.accumulate(power)
            inverse = np.full(len(h) + 1, np.uint64(pow(base, -1, 1 << 64)))
            inverse[0] = ONE
            inverse = np.multiply.accumulate(inverse)
            x = h if lane == 0 else mix64(h ^ np.uint64(BASES[lane]))
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(x * power[:-1], out=sums[1:])
            self.lanes.append((sums, inverse))

    def of(self, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        sums, inverse = self.lanes[lane]
        return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(BASES[1]))


class Anchors:
    """Minimizers of a batch of documents (``h``: word hashes of all, ``lengths``: words each).

    Of every window of ``n`` words, the k-mers with the smallest hash are anchors.  Which
    k-mers a window selects depends on its words alone, so equal windows have equal anchors.
    """

    def __init__(self, h: np.ndarray, lengths: np.ndarray, n: int, k: int):
        self.n, self.k, total, w = n, k, len(h), n - k + 1
        ends = np.cumsum(lengths)
        self.doc_of = np.repeat(np.arange(len(lengths)), lengths)
        self.begin, self.end = (np.repeat(x, lengths) for x in (ends - lengths, ends))
        room = self.end - np.arange(total)  # words from here to the document's end
        self.kmer = rolling(h, k)
        self.kmer[room[:len(self.kmer)] < k] = LAST
        self.low = sliding(self.kmer, w, np.minimum)  # of each window
        self.window = room[:len(self.low)] >= n
        self.low[~self.window] = 0
        pad = np.zeros(w - 1, np.uint64)
        high = sliding(np.concatenate([pad, self.low, pad]), w, np.maximum) if len(self.low) else self.kmer[:0]
        self.at = np.flatnonzero((high == self.kmer[:len(high)]) & (high > 0) & (high < LAST))
        self.hash = self.kmer[self.at]
        doc = self.doc_of[self.at]
        same = doc[1:] == doc[:-1]
        none = np.zeros(min(1, len(doc)), bool)
        self.has_prev, self.has_next = np.concatenate([none, same]), np.concatenate([same, none])
        before, after = np.roll(self.at, 1), np.roll(self.at, -1)
        #: the text common to the anchor's two edges: from the previous anchor (or the document's
        #: start) to the end of the next one (or of the document)
        self.left = np.where(self.has_prev, before, self.begin[self.at])
        self.right = np.where(self.has_next, after + k, self.end[self.at])

    def edges(self, p: Polynomial) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the edges into and out of each anchor: their words, and whether they
        start or end with the document."""
        into = p.of(self.left, self.at + self.k) ^ np.where(self.has_prev, np.uint64(0), np.uint64(BASES[0]))
        out = p.of(self.at, self.right) ^ np.where(self.has_next, np.uint64(0), np.uint64(BASES[1]))
        return into, out


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased; a text of
    fewer words is one shingle, one without words has none."""
    words = [(t or b"").lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    h = hash_words([x for w in words for x in w])
    grams, out, at = rolling(h, k), [], 0
    for n in lengths.tolist():
        if n >= k:
            out.append(np.unique(grams[at:at + n - k + 1]))
        else:  # the number of words is part of the hash
            out.append(mix64(rolling(h[at:at + n], n) + np.uint64(n)) if n else grams[:0])
        at += n
    return out
