"""Words of many texts at once, as arrays: where they stand, and a 64-bit hash of each. No Python object is made for a word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: White space of the contracts, which is also that of bytes.split().
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64)
#: Bytes that are looked at together: some sixty times as much memory is held meanwhile.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Tokens:
    """Splits and hashes; keeps the powers that the hashes need."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.read = 0  # bytes of the chunk that was given last

    def factors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two odd numbers for each place in a sequence."""
        self._grow(int(at.max(initial=0)) + 1)
        return self.powers[at], self.inverses[at]

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            self.powers, self.inverses = (_powers(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    def hashed(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends and hashes of the words of a text."""
        letters = np.frombuffer(text, np.uint8)
        space = np.ones(len(letters) + 2, bool)
        space[1:-1] = SPACES[letters]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        self._grow(len(letters) + 1)
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(_LETTERS[letters] * self.powers[: len(letters)], out=sums[1:])
        sized = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return starts, ends, mix((sums[ends] - sums[starts]) * self.inverses[starts] + sized)

    def chunks(self, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Place of each chunk, and starts, ends and hashes of the words in it; no word is cut."""
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > CHUNK:
                cut = max(text.rfind(b"\n", at, at + CHUNK), text.rfind(b" ", at, at + CHUNK))
                if cut <= at:
                    found = _SPACE.search(text, at + CHUNK)
                    cut = found.start() if found else stop
                stop = min(cut + 1, len(text))
            self.read = stop - at
            yield at, *self.hashed(text[at:stop])
            at = stop


def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)
