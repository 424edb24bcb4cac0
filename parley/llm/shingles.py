"""Sets of word shingles as sorted 64-bit hashes, and their HyperMinHash registers."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE = 200_000

#: Registers of a set, and the bits that each keeps of its smallest hash: a leading-zero count and a mantissa.
REGISTERS = 128
MANTISSA = 10
_BUCKET_BITS = REGISTERS.bit_length() - 1
_REST = 64 - _BUCKET_BITS

_WORDS: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word, A-Z lower-cased; words are runs without ASCII white space."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    known = _WORDS
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > CACHE:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in words:
            if w not in known:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of fewer words, the whole sequence is one shingle."""
    w = word_hashes(text)
    if len(w) == 0:
        return w
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.full(m, len(w) if len(w) < n else n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m])
    return np.unique(h)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash: per bucket (top bits) the smallest rest's leading-zero count and next bits; 0: empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(s) == 0:
        return out
    bucket = (s >> np.uint64(_REST)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first of a bucket is its smallest
    rest = s[first] & np.uint64((1 << _REST) - 1)
    # width of the rest in bits; float conversion may round up to the next power of two, so it is put right
    width = np.zeros(len(rest), np.int64)
    big = rest > 0
    width[big] = np.floor(np.log2(rest[big].astype(np.float64))).astype(np.int64) + 1
    width[big] -= (rest[big] >> (np.maximum(width[big] - 1, 0)).astype(np.uint64)) == 0
    zeros = np.minimum(_REST - width, 62)
    shift = np.maximum(width - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((zeros + 1) << MANTISSA).astype(np.uint64) | mantissa
    return out


def expected_collisions(n: int, m: int) -> float:
    """Chance that registers of two disjoint sets of ``n`` and ``m`` elements agree by their few bits."""
    a, b = max(n / REGISTERS, 1e-9), max(m / REGISTERS, 1e-9)
    p = 2.0 ** np.arange(0, 40)
    # smallest of k uniform values lies in [2^-(z+1), 2^-z) with chance exp(-k 2^-(z+1)) - exp(-k 2^-z)
    za = np.exp(-a / (2 * p)) - np.exp(-a / p)
    zb = np.exp(-b / (2 * p)) - np.exp(-b / p)
    return float((za * zb).sum() / (1 << MANTISSA))


def estimate(agree: np.ndarray, filled: np.ndarray, collide: float) -> np.ndarray:
    """Jaccard similarity from registers that agree, of those that are filled in either set, less chance agreement."""
    raw = agree / np.maximum(filled, 1)
    return np.clip((raw - collide) / (1 - collide), 0, 1)
