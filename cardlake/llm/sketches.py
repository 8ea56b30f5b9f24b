"""Shingles of texts and their SetSketch registers, as numpy arrays inside a task.

A register is the least of one exponential variable per shingle, on an exponential scale of base ``BASE`` and cut off
at both ends. The registers of a union are the maxima of the registers of its parts; two sets agree in a register with
a probability of about their Jaccard similarity. The sizes of two sets and the numbers of registers in which the one
or the other is larger give the likelihood of every similarity.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

BASE, RATE, TOP = 1.001, 20.0, 65535
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20250530))
_LETTER = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# A multiplier for each place of a shingle and a salt for each number of words.
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_REGISTER = _random.integers(1, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Log likelihood below the best at which a similarity is ruled out: about one in 10^8 true pairs is lost.
MARGIN = 16.0
_EMPTY = np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    inside = ~SPACE[joined]
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    if not len(starts):
        return _EMPTY, np.zeros(len(texts), np.int64)
    spots = np.flatnonzero(inside)
    first = np.searchsorted(spots, starts)
    sizes = np.diff(np.append(first, len(spots)))
    place = np.arange(len(spots)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    sums = np.add.reduceat(_LETTER[joined[spots]] * powers[place], first)
    per_text = np.diff(np.searchsorted(starts, np.append(0, np.cumsum(lengths))))
    return mixed(sums + sizes.astype(np.uint64)), per_text


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the ``width``-word shingles of each text, with A-Z in lower case.

    Fewer words are one shingle, no words none.
    """
    hashes, counts = word_hashes([text.encode().lower() for text in texts])
    salt = mixed(np.arange(width + 1, dtype=np.uint64) + np.uint64(1))
    windows = max(0, len(hashes) - width + 1)
    rolled = np.zeros(windows, np.uint64)
    for j in range(width):
        rolled += hashes[j : j + windows] * _PLACE[j]
    rolled = mixed(rolled + salt[width])
    found, at = [], 0
    for count in counts.tolist():
        if count >= width:
            found.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            found.append(mixed((hashes[at : at + count] * _PLACE[:count]).sum(keepdims=True) + salt[count]))
        else:
            found.append(_EMPTY)
        at += count
    return found


def registers(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The registers of each set, which must not be empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((size, len(sets)), np.uint64)
    for i in range(size):
        drawn = joined * _REGISTER[0, i]
        drawn ^= drawn >> np.uint64(32)
        drawn *= _REGISTER[1, i]
        least[i] = np.minimum.reduceat(drawn, starts)
    smallest = -np.log1p(-(least.T.astype(np.float64) + 0.5) * 2.0**-64) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(np.uint16)


def digest(shingle_set: np.ndarray) -> bytes:
    return blake2b(shingle_set.tobytes(), digest_size=16).digest()


def _larger(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(more: np.ndarray, less: np.ndarray, size: int, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log likelihood of a similarity, where a is larger in ``more`` and b in ``less`` of the registers."""
    u = n_a / (n_a + n_b)
    tiny = 1e-12
    p_more = np.maximum(_larger(np.maximum(u - (1 - u) * similarity, 0)), tiny)
    p_less = np.maximum(_larger(np.maximum(1 - u - u * similarity, 0)), tiny)
    return more * np.log(p_more) + less * np.log(p_less) + (size - more - less) * np.log(np.maximum(1 - p_more - p_less, tiny))


def estimates(more: np.ndarray, less: np.ndarray, size: int, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and whether ``threshold`` or more can't be ruled out."""
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    most = np.minimum(n_a / n_b, n_b / n_a)
    low, high = np.zeros(len(more)), most.copy()
    golden = (5**0.5 - 1) / 2
    for _ in range(30):  # the likelihood has one maximum
        left, right = high - golden * (high - low), low + golden * (high - low)
        rises = likelihood(more, less, size, n_a, n_b, left) < likelihood(more, less, size, n_a, n_b, right)
        low, high = np.where(rises, left, low), np.where(rises, high, right)
    best = (low + high) / 2
    short = likelihood(more, less, size, n_a, n_b, best) - likelihood(more, less, size, n_a, n_b, np.minimum(threshold, most))
    return best, (most >= threshold) & ((best >= threshold) | (short <= MARGIN))


def fewest_equal(size: int, threshold: float) -> int:
    """Registers in which two sets of this similarity agree at least, but for six standard deviations."""
    return max(0, int(size * threshold - 6 * (size * threshold * (1 - threshold)) ** 0.5))
