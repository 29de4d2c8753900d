"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

``slices`` cuts a batch of texts into runs of bounded size, so memory follows one run (or one text, if a
single text is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts with at most ``limit`` characters together, one text at least."""
    begin, chars = 0, 0
    for n, text in enumerate(texts):
        if n > begin and chars + len(text) > limit:
            yield begin, n
            begin, chars = n, 0
        chars += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def hash_runs(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the symbols of each run: a polynomial over mixed symbols, then mixed with the length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    at = np.repeat(starts, lengths) + within
    powers = np.cumprod(np.full(int(lengths.max()), np.uint64(0x100000001B3)))
    sums = np.add.reduceat(mix(symbols[at] + _STEP) * powers[within], first)
    return mix(sums + lengths.astype(np.uint64) * _STEP)


_ASCII_LOWER = np.arange(256, dtype=np.uint64)
_ASCII_LOWER[65:91] += np.uint64(32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def plain_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z lower-cased, cut at ASCII white space; and the
    position of each text's first word, with the total at the end."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, ends = runs(~_BLANK[data])
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return hash_runs(_ASCII_LOWER[data], starts, ends), offsets


def shingled(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside each text, and the position of each text's first one.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(bounds[-1], np.uint64)
    long = counts >= size
    if long.any():
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled += words[k : len(words) - size + 1 + k] * np.uint64(2 * k * k + 12 * k + 1)
            rolled = mix(rolled)
        n = made[long]
        first = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(first, n)
        out[np.repeat(bounds[:-1][long], n) + within] = rolled[np.repeat(offsets[:-1][long], n) + within]
    for d in np.flatnonzero((counts > 0) & ~long):
        value = np.full(1, counts[d], np.uint64)
        for n in range(offsets[d], offsets[d + 1]):
            value = mix(value * _STEP + words[n : n + 1])
        out[bounds[d]] = value[0]
    return out, bounds


class Letters:
    """Tables over code points: which are letters or digits, and their lower case."""

    def __init__(self):
        size = 0x110000
        chars = [chr(i) for i in range(size)]
        self.letter = np.fromiter((c.isalpha() for c in chars), bool, size)
        self.word = np.fromiter((c.isalnum() for c in chars), bool, size)
        self.lower = np.fromiter(
            (ord(low) if len(low := c.lower()) == 1 else n for n, c in enumerate(chars)), np.uint32, size
        )

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased code points of all texts, each followed by a line feed; and where each text begins."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.lower[codes]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        return codes, np.concatenate(([0], np.cumsum(sizes)))


class Own(list):
    """What a process has built for itself: it does not go with functions that are sent elsewhere."""

    def __reduce__(self):
        return Own, ()


_letters: list[Letters] = Own()


def letters() -> Letters:
    """The tables, built once per process."""
    if not _letters:
        _letters.append(Letters())
    return _letters[0]
