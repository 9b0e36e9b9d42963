"""Word and word-run hashes of many texts at once, in numpy.

A batch of texts becomes one byte buffer; word boundaries come from a character table and
word hashes from prefix sums of a polynomial over the buffer, so no Python code runs per
word. All hashes are 64 bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x100000001B3 | 1)
#: Bytes of text hashed at a time; a longer single text is still taken whole.
PIECE = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + (1 << 16))
        for name, base in (("up", int(BASE)), ("down", _inverse(int(BASE)))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def alphabet(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


#: Words of letters and digits, and of letters, digits and the underscore.
ALNUM = alphabet("abcdefghijklmnopqrstuvwxyz0123456789")
ALNUM_ = alphabet("abcdefghijklmnopqrstuvwxyz0123456789_")


class Words:
    """Words of some texts in order: ``doc`` (position of the text), ``start`` and ``end`` in ``data``, ``hash``."""

    def __init__(self, texts: list[str], chars: np.ndarray):
        parts = [t.lower().encode("utf-8", "replace") for t in texts]
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.data = data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = chars[data]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        up, down = _power_tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``doc``, position of the first word and hash of every run of ``n`` words within one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, np.uint64)
        if n <= 4:
            h = np.zeros(m, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + self.hash[i : i + m]
        else:  # Karp-Rabin: the same polynomial for any n from prefix sums
            up, down = _power_tables(len(self.hash) + 1)
            sums = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * up[: len(self.hash)], out=sums[1:])
            h = (sums[n:] - sums[:-n]) * down[:m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return self.doc[at], at, mix(h[at])


def pieces(texts: list[str], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` characters together."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
