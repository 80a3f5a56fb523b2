"""Distinct word shingles of many texts at once, as 64-bit hashes.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A text's set holds the hashes of its
distinct runs of `size` words; a text with fewer words has its whole sequence as one; without words
the set is empty. Word hashes come from running sums over the bytes of a whole batch, so no word is
handled on its own. Two different shingles share a hash with probability 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
PRIME = 0x9E3779B97F4A7C15 | 1
PIECE = 800_000  # bytes of text hashed at once
ROWS = 512  # texts of a batch that are Python strings at once
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, PRIME, dtype=_U)
    up[0] = 1
    down = np.full(n, pow(PRIME, -1, 2**64), dtype=_U)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte buffer that begins and ends with white space."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    running = np.cumsum(LOWER[data].astype(_U) * up[:len(data)])
    h = (running[end - 1] - running[start - 1]) * down[start]
    return mixed(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)), start


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    opens = np.concatenate([[1], 1 + np.cumsum(lengths)])
    words, start = _word_hashes(data)
    first = np.searchsorted(start, opens)
    weights = [_U(pow(PRIME, 3 + 2 * k, 2**64)) for k in range(size)]
    runs = np.zeros(max(0, len(words) - size + 1), dtype=_U)
    for k in range(size):
        runs += words[k:k + len(runs)] * weights[k]
    runs = mixed(runs)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            s = np.sort(runs[a:b - size + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            short = sum(int(words[a + k]) * int(weights[k]) for k in range(b - a)) + int(b - a) * PRIME
            yield mixed(np.array([short % 2**64], dtype=_U))
        else:
            yield np.zeros(0, dtype=_U)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text, in order."""
    held: list[bytes] = []
    total = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        if held and total + len(raw) > PIECE:
            yield from _sets(held, size)
            held, total = [], 0
        held.append(raw)
        total += len(raw)
    if held:
        yield from _sets(held, size)


def batch_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """shingle_sets() of a column of texts. A worker keeps the most memory it ever took, also while
    later stages run beside it, so only a few rows at a time become strings."""
    for at in range(0, len(column), ROWS):
        yield from shingle_sets(column.slice(at, ROWS).to_pylist(), size)
