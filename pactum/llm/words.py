"""Words and their 64-bit hashes for whole chunks of text at once, in numpy.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z in lower case.  All arithmetic is
modulo 2**64.  Equal words have equal hashes; different words collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, step in (("up", _STEP), ("down", _BACK)):
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if n > 1 << 24:  # one long text shouldn't stay in memory
        _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word with the total as last entry)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = LOWER[data]
    edge = IS_SPACE[data]
    begins = ~edge
    begins[1:] &= edge[:-1]
    ends = ~edge
    ends[:-1] &= edge[1:]
    at = offsets[(offsets > 0) & (offsets < n)]
    begins[at] |= ~edge[at]
    ends[at - 1] |= ~edge[at - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[ends] - total[begins]) * down[begins]
    return mixed(h), np.searchsorted(begins, offsets)


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def hash_runs(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of `width` words; a text of fewer words gives all its words as one run."""
    owner, counts = owners(firsts), np.diff(firsts)
    found, texts = [], []
    for size in range(1, width + 1):
        m = len(words) - size + 1
        if m <= 0:
            break
        if size < width:
            starts = firsts[:-1][counts == size]
            if not len(starts):
                continue
        else:
            starts = np.flatnonzero(owner[:m] == owner[size - 1 :])
        h = np.full(len(starts), size, np.uint64)
        for k in range(size):
            h = h * _STEP + words[starts + k]
        found.append(mixed(h))
        texts.append(owner[starts])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(texts)


def distinct_runs(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As `hash_runs`, without repeats, ordered by text and hash."""
    h, text = hash_runs(words, firsts, width)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
    return h, text
