"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item has a 64-bit SimHash of its word shingles. A document's windows as long as the item are
fingerprinted where they share a shingle with it (elsewhere the similarity is 0). Fingerprints are cut into
BLOCKS blocks; if two differ in at most RADIUS bits, one block differs in at most RADIUS // BLOCKS bits, so
looking up all values that near in each block finds every item within the radius. What is found is verified
by exact similarity: shingles weighted by their counts, sum of minima over sum of maxima.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import small_batches, without_ids
from tiffin.llm.shingles import hash_runs, letters, mix, runs, shingled, slices

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: At similarity 0.8 two fingerprints differ in 9.5 of 64 bits on average, with a deviation of 2.9.
RADIUS = 19
#: Widths of the blocks of a fingerprint.
WIDTHS = (13, 13, 13, 13, 12)
NEAR = RADIUS // len(WIDTHS)
#: Items that one pass over the documents looks for, and the characters they may have together.
PASS_ITEMS = 4_096
PASS_CHARS = 8_000_000

FOUND = "doc_id long, item_id long, similarity double, window_start long, window_words long"
_SHIFTS = np.concatenate(([0], np.cumsum(WIDTHS)[:-1])).astype(np.uint64)
_BITS = np.arange(64, dtype=np.uint64)


def words_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters and digits, and where each text's words begin."""
    table = letters()
    codes, offsets = table.codes(texts)
    starts, ends = runs(table.word[codes])
    return hash_runs(codes.astype(np.uint64), starts, ends), np.searchsorted(starts, offsets)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``: per bit, the majority of the shingles."""
    low, high = int(starts.min()), int(starts.max()) + size
    bits = ((mix(shingles[low:high])[:, None] >> _BITS) & np.uint64(1)).astype(np.int32)
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    ones = sums[starts - low + size] - sums[starts - low]
    return ((2 * ones > size).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts of each shingle over the sum of the larger."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(place[: len(a)], minlength=len(values))
    right = np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


class Items:
    """A bounded set of benchmark items: shingles, fingerprints and block tables."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        words, word_at = words_in(texts)
        shingles, at = shingled(words, word_at, size)
        counts = np.diff(word_at)
        kept = np.flatnonzero(counts >= size)
        # Items of fewer words are one shingle, so a window is equal or has nothing of it: by number of words.
        self.short = {}
        for k in range(1, size):
            some = np.flatnonzero(counts == k)
            if len(some):
                values = np.concatenate([shingled(words[word_at[n] : word_at[n + 1]], np.array([0, k]), k)[0] for n in some])
                order = np.argsort(values, kind="stable")
                self.short[k] = values[order], np.array([ids[n] for n in some], np.int64)[order]
        self.ids = np.array([ids[n] for n in kept], np.int64)
        self.words = np.array([word_at[n + 1] - word_at[n] for n in kept], np.int64)
        self.shingles = [shingles[at[n] : at[n + 1]] for n in kept]
        self.sizes = np.array([len(s) for s in self.shingles], np.int64)
        self.prints = np.array(
            [fingerprints(s, np.zeros(1, np.int64), len(s))[0] for s in self.shingles], np.uint64
        )
        pairs = sorted({(int(v), n) for n, s in enumerate(self.shingles) for v in s})
        self.values = np.array([v for v, _ in pairs], np.uint64)  # sorted, with the item of each
        self.owners = np.array([n for _, n in pairs], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.values & np.uint64((1 << 20) - 1)] = True
        self.blocks = []
        for shift, width in zip(_SHIFTS, WIDTHS):
            own = (self.prints >> shift) & np.uint64((1 << width) - 1)
            masks = [sum(1 << b for b in some) for k in range(NEAR + 1) for some in combinations(range(width), k)]
            near = (own[:, None] ^ np.array(masks, np.uint64)).astype(np.int64)
            order = np.argsort(near, axis=None, kind="stable")
            bounds = np.searchsorted(near.ravel()[order], np.arange((1 << width) + 1))
            self.blocks.append((bounds, (order // len(masks)).astype(np.int64)))

    def within(self, fingerprint: np.uint64, radius: int) -> np.ndarray:
        """Items whose fingerprint differs in at most ``radius`` bits."""
        found = []
        for (bounds, owners), shift, width in zip(self.blocks, _SHIFTS, WIDTHS):
            value = int((fingerprint >> shift) & np.uint64((1 << width) - 1))
            found.append(owners[bounds[value] : bounds[value + 1]])
        some = np.unique(np.concatenate(found))
        return some[np.bitwise_count(self.prints[some] ^ fingerprint) <= radius]

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that an item has, and the item, one row for each."""
        some = np.flatnonzero(self.filter[shingles & np.uint64((1 << 20) - 1)])
        left = np.searchsorted(self.values, shingles[some], "left")
        many = np.searchsorted(self.values, shingles[some], "right") - left
        first = np.cumsum(many) - many
        at = np.repeat(left - first, many) + np.arange(many.sum())
        return np.repeat(some, many), self.owners[at]


def _consecutive(starts: np.ndarray, limit: int = 4096) -> Iterator[np.ndarray]:
    """Runs of consecutive numbers, of ``limit`` at most."""
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
        for begin in range(0, len(run), limit):
            yield run[begin : begin + limit]


def _search(items: Items, shingles: np.ndarray, threshold: float):
    """(item, similarity, first word) of the best verified window for each item found in one document."""
    at, owners = items.hits(shingles)
    best: dict[int, tuple[float, int]] = {}
    for size in np.unique(items.sizes[owners]):
        # Windows of this size that share a shingle with an item of this size.
        spots = np.unique(at[items.sizes[owners] == size])
        if len(shingles) < size:  # a document shorter than the item is one window
            starts, width = np.zeros(1, np.int64), len(shingles)
        else:
            opened = np.zeros(len(shingles) + 1, np.int64)
            opened[np.maximum(0, spots - size + 1)] += 1  # spots are unique, so only those at 0 can coincide
            opened[0] = np.count_nonzero(spots < size)
            opened[spots + 1] -= 1
            starts, width = np.flatnonzero(np.cumsum(opened)[: len(shingles) - size + 1] > 0), int(size)
        for some in _consecutive(starts):
            for start, fingerprint in zip(some, fingerprints(shingles, some, width)):
                for n in items.within(fingerprint, RADIUS):
                    if items.sizes[n] == size:
                        alike = similarity(shingles[start : start + width], items.shingles[n])
                        if alike >= threshold and (int(n) not in best or alike > best[int(n)][0]):
                            best[int(n)] = (alike, int(start))
    return [(n, alike, start) for n, (alike, start) in best.items()]


def _search_short(items: Items, words: np.ndarray, word_at: np.ndarray):
    """(document, item id, first word, words) where an item of fewer words than a shingle first stands in a document."""
    for k, (values, owners) in items.short.items():
        shingles, at = shingled(words, word_at, k)
        shingles = shingles[np.repeat(np.diff(word_at) >= k, np.diff(at))]
        at = np.concatenate(([0], np.cumsum(np.where(np.diff(word_at) >= k, np.diff(at), 0))))
        left = np.searchsorted(values, shingles, "left")
        many = np.searchsorted(values, shingles, "right") - left
        spots = np.repeat(np.arange(len(shingles)), many)
        found = owners[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())]
        docs = np.searchsorted(at, spots, "right") - 1
        seen = set()
        for d, item, start in zip(docs.tolist(), found.tolist(), (spots - at[docs]).tolist()):
            if (d, item) not in seen:
                seen.add((d, item))
                yield d, item, start, k


def _chunks(benchmark: DataFrame) -> Iterator[list]:
    """The items in runs of bounded count and size, read one partition at a time."""
    run, chars = [], 0
    for row in benchmark.toLocalIterator():
        if run and (len(run) == PASS_ITEMS or chars + len(row["text"]) > PASS_CHARS):
            yield run
            run, chars = [], 0
        run.append(row)
        chars += len(row["text"])
    if run:
        yield run


def matches(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS
) -> DataFrame:
    """One row per document and item it holds: similarity and place (in words) of the best window.

    Words are lower-cased runs of letters and digits. Texts of fewer words than a shingle are one shingle,
    so an item that short is found where it stands word by word.
    Null and empty texts, of documents or items, match nothing; rows without doc_id are searched too, and items without
    item_id looked for. Of equal items each is found; of equal windows the first counts. Empty tables give no rows. The items are a stated
    query set: they go over all documents in runs of PASS_ITEMS at most, so what is sent to a task is bounded.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # Ids as text: a batch with null ids would come as floats.
    doc_id = F.col("doc_id").cast("long").cast("string").alias("doc_id")
    texts = docs.select(doc_id, "text").filter("text IS NOT NULL")
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    out = spark.createDataFrame([], FOUND)
    for run in _chunks(wanted):
        sent = spark.sparkContext.broadcast(([r["item_id"] for r in run], [r["text"] for r in run]))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            # Items are numbered, since an item_id may be null or stand for several.
            items = Items(list(range(len(sent.value[1]))), sent.value[1], size)
            item_ids = sent.value[0]
            for batch in batches:
                ids = [None if i is None else int(i) for i in batch["doc_id"]]
                texts, found = batch["text"].tolist(), []
                for begin, end in slices(texts):
                    words, word_at = words_in(texts[begin:end])
                    shingles, at = shingled(words, word_at, size)
                    for d, item, start, k in _search_short(items, words, word_at):
                        found.append((ids[begin + d], item, 1.0, start, k))
                    doc_of = np.searchsorted(at, items.hits(shingles)[0], "right") - 1 if len(items.ids) else []
                    for d in np.unique(doc_of):
                        own = shingles[at[d] : at[d + 1]]
                        for n, alike, start in _search(items, own, threshold):
                            found.append((ids[begin + d], int(items.ids[n]), alike, start, int(items.words[n])))
                out = pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])
                out["doc_id"] = pd.array([row[0] for row in found], "Int64")
                out["item_id"] = pd.array([item_ids[row[1]] for row in found], "Int64")
                yield out

        out = out.unionByName(texts.mapInPandas(search, FOUND))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns are kept. Rows without doc_id stay."""
    return without_ids(docs, matches(docs, benchmark, **settings).select("doc_id"))
