"""Hashes of the words of many texts at once, in NumPy.

Words are what stands between ASCII white space, A-Z lower-cased if asked. A word's 64-bit hash is
a polynomial over a fixed random value per byte, taken from one running sum over the
buffer, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
STEP = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_CASED = np.random.default_rng(2024).integers(1, 2 ** 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _CASED.copy()
_FOLDED[65:91] = _FOLDED[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class WordHasher:
    """Keeps the powers of the base; one per task."""

    def __init__(self, fold: bool = True):
        self.values = _FOLDED if fold else _CASED
        inverse = pow(int(BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate(([U(1)], np.full(2 * STEP, BASE))))
            self.down = np.cumprod(np.concatenate(([U(1)], np.full(2 * STEP, U(inverse)))))

    def _piece(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space = SPACE[part]
        edge = np.diff(space.astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(part) > 2 * STEP:  # one word of over a MB among them: grow the powers for it
            self.up, self.down = (np.cumprod(np.concatenate(([U(1)], np.full(len(part), p[1])))) for p in (self.up, self.down))
        total = np.concatenate(([U(0)], np.cumsum(self.values[part] * self.up[:len(part)])))
        return start, end, mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and byte lengths of all words in order, and the number of words of each text."""
        return self.placed_words(texts)[:3]

    def placed_words(self, texts: list[bytes]):
        """The same, and the words' places in the texts joined by newlines, and those."""
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        hashes, lengths, places, at = [], [], [], 0
        while at < len(buffer):
            stop = min(at + STEP, len(buffer))
            if stop < len(buffer):
                back = np.flatnonzero(SPACE[buffer[max(at, stop - 4096):stop]])
                if len(back):
                    stop = max(at, stop - 4096) + int(back[-1]) + 1
                else:
                    while not SPACE[buffer[stop - 1]]:
                        ahead = np.flatnonzero(SPACE[buffer[stop:stop + STEP]])
                        stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + STEP, len(buffer))
            start, end, h = self._piece(buffer[at:stop])
            hashes.append(h)
            lengths.append(end - start)
            places.append(start + at)
            at = stop
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        upto = np.searchsorted(places, ends)
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
                np.concatenate(lengths) if lengths else np.zeros(0, np.int64), np.diff(upto, prepend=0), places, buffer)


def batches_of(sizes: list[int], most: int = 1 << 22):
    """Ranges of consecutive texts of about `most` bytes together; a longer text is alone."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)
