"""Spelling variants: words one edit apart, by dense comparison of padded code-point matrices.

Two words differ in one inserted, deleted or replaced code point if and only if their common prefix and their
common suffix together reach the longer length minus one. The possible lengths of the prefix are cut into CELLS
ranges: a pair whose prefix falls into the range from a up to b shares its first a code points and its last
(longer - b) ones, so its words meet in the bucket of that cell, that longer length and those code points.

Each bucket is a tile: its words are rows of two matrices, one aligned at the beginnings and one at the ends, and all
rows are compared with all rows column by column. Small buckets are stacked and compared at once; buckets of more than
BLOCK words are cut into blocks, and each pair of blocks is a tile of its own.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import pinned, small_batches
from tiffin.llm.shingles import slices

MIN_LENGTH = 5
MIN_COUNT = 3
#: A form has at least so many times the occurrences of its variant.
RATIO = 2
#: One occurrence in so many, chosen by a hash, loses a code point.
DAMAGE = 97
RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: Ranges that the length of the common prefix is cut into: the more, the smaller the tiles and the more of them.
CELLS = 3
#: Words of a bucket that are compared with each other in one task.
BLOCK = 4_096
#: Rows of buckets that a task takes together.
RANGE_ROWS = 250_000
#: Pairs that one step compares.
STEP = 1 << 20
#: Large buckets that are listed to every task, at most; beyond that they are joined.
LISTED = 50_000
#: Words that a counting task holds before it sends them on.
HELD_WORDS = 300_000
#: Bytes up to which a run's hash is put together from that of its document and its own.
SHORT_RUN = 48
_CRC = np.array([zlib.crc32(bytes([n])) for n in range(256)], np.uint32)
_CRC ^= _CRC[0]  # the update by one byte, without the inversions at the ends


class Tally(dict):
    """Number of each run, by its text as it stands; runs that are equal in lower case share one."""

    def __init__(self):
        self.words: list[str] = []
        self.lengths = array("q")
        self.crcs = array("I")
        self.of: dict[str, int] = {}

    def __missing__(self, run: str) -> int:
        word = run.lower() if run.isascii() else run.translate(LOWER)
        n = self.of.get(word)
        if n is None:
            n = self.of[word] = len(self.words)
            raw = word.encode()
            self.words.append(word)
            self.lengths.append(len(raw))
            self.crcs.append(zlib.crc32(raw))
        self[run] = n
        return n


def _tally(tally: Tally, ids: list[str], texts: list[str], damage: int) -> tuple[np.ndarray, list[str]]:
    """Numbers of the undamaged runs of ``texts``, and the damaged ones after their loss."""
    found = [re.findall(RUN, text) for text in texts]
    sizes = np.fromiter((len(f) for f in found), np.int64, len(found))
    words = np.fromiter(map(tally.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
    docs = np.repeat(np.arange(len(texts)), sizes)
    lengths, crcs = np.array(tally.lengths), np.array(tally.crcs)
    # The hash of a joined text is that of its first part, moved on by the length of the second, xor that of the second.
    moved = np.zeros((SHORT_RUN + 1, len(ids)), np.uint32)
    moved[0] = [zlib.crc32(f"{doc_id}:".encode()) for doc_id in ids]
    for n in range(SHORT_RUN):
        moved[n + 1] = _CRC[moved[n] & 255] ^ (moved[n] >> 8)
    hashes = moved[np.minimum(lengths[words], SHORT_RUN), docs] ^ crcs[words]
    for at in np.flatnonzero(lengths[words] > SHORT_RUN):
        hashes[at] = zlib.crc32(f"{ids[docs[at]]}:{tally.words[words[at]]}".encode())
    hit = hashes % np.uint32(damage) == 0
    lost = []
    for at in np.flatnonzero(hit):
        word = tally.words[words[at]]
        cut = int(hashes[at]) % len(word)
        lost.append(word[:cut] + word[cut + 1 :])
    return words[~hit], lost


def word_counts(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of all runs of letters of ``docs`` (doc_id, text), lower-cased in A to Z.

    A run whose ``crc32("<doc_id>:<run>")`` is a multiple of ``damage`` loses the code point at that hash modulo
    its length. Null texts have no runs; a null doc_id is written as nothing. Empty results are left out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, totals = Tally(), np.zeros(0, np.int64)

        def held():
            some = np.flatnonzero(totals)
            return pd.DataFrame({"word": np.array(tally.words, object)[some], "n": totals[some]})

        for batch in batches:
            ids, texts = batch["_id"].tolist(), batch["text"].tolist()
            for begin, end in slices(texts):
                words, lost = _tally(tally, ids[begin:end], texts[begin:end], damage)
                some = np.bincount(words, minlength=len(tally.words))
                some[: len(totals)] += totals
                totals = some
                if lost:
                    yield pd.DataFrame({"word": lost, "n": 1})
                if len(tally) > HELD_WORDS:
                    yield held()
                    tally, totals = Tally(), np.zeros(0, np.int64)
        yield held()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text")
    counted = texts.filter("text IS NOT NULL").mapInPandas(count, "word string, n long")
    return counted.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``words`` aligned at the beginnings and at the ends, padded with 0; and the lengths."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint8 if codes.size and codes.max() < 256 else np.uint32)
    wide = int(lengths.max()) if len(words) else 0
    owner = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    heads, tails = np.zeros((len(words), wide), codes.dtype), np.zeros((len(words), wide), codes.dtype)
    heads[owner, column] = codes
    tails[owner, column + wide - lengths[owner]] = codes
    return heads, tails, lengths


def common(left: np.ndarray, right: np.ndarray, most: np.ndarray, backward: bool) -> np.ndarray:
    """How many columns all rows of ``left`` (tiles, rows, columns) share with those of ``right`` from one side."""
    wide = left.shape[2]
    alive = np.ones(most.shape, bool)
    out = np.zeros(most.shape, np.int16)
    for k in reversed(range(wide)) if backward else range(wide):
        alive &= left[:, :, None, k] == right[:, None, :, k]
        if not alive.any():
            break
        out += alive
    return np.minimum(out, most)


def bounds(longer, cell):
    """Where the cell's range of prefix lengths begins and stops, for a pair with this longer length."""
    return longer * cell // CELLS, longer * (cell + 1) // CELLS


def near(heads, tails, lengths, rows: np.ndarray, others: np.ndarray, longer: np.ndarray, cell: np.ndarray):
    """Pairs of row numbers, one of ``rows`` and one of ``others`` of the same tile, that are one edit apart.

    ``rows`` and ``others`` are (tiles, width) row numbers, -1 where a tile has fewer. A pair counts in the tiles of its
    longer length and of the cell that its prefix falls into, so it is found once.
    """
    a, b = lengths[rows][:, :, None], lengths[others][:, None, :]
    least, most = np.minimum(a, b).astype(np.int16), np.maximum(a, b)
    low, high = (x[:, None, None] for x in bounds(longer, cell))
    wanted = (most == longer[:, None, None]) & (most - least <= 1)
    wanted &= (rows >= 0)[:, :, None] & (others >= 0)[:, None, :]
    prefix = common(heads[rows], heads[others], least, False)
    wanted &= (prefix >= low) & (prefix < high)
    wanted &= prefix + common(tails[rows], tails[others], least, True) >= most - 1
    tile, x, y = np.nonzero(wanted)
    return rows[tile, x], others[tile, y]


def _stacks(starts: np.ndarray, sizes: np.ndarray):
    """Buckets of similar size together: their numbers and a (buckets, width) matrix of row numbers, -1 as padding."""
    width = 2
    while (sizes > width // 2).any():
        own = np.flatnonzero((sizes > width // 2) & (sizes <= width) & (sizes > 1))
        step = max(1, STEP // (width * width))
        for n in range(0, len(own), step):
            some = own[n : n + step]
            at = np.arange(width)
            yield some, np.where(at < sizes[some, None], starts[some, None] + at, -1)
        width *= 2


def tiles(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) in both directions of the near words of the buckets in ``rows``.

    ``rows`` has cell, longer, bucket (a hash; equal ones of different code points only make a tile larger), tile (which
    pair of blocks), block (0 or 1: of which one), word and n.
    """
    columns = [rows[c].to_numpy() for c in ("block", "tile", "longer", "cell", "bucket")]
    order = np.lexsort(columns)
    block, tile, longer, cell, bucket = (c[order] for c in columns)
    new = np.ones(len(rows), bool)
    new[1:] = (tile[1:] != tile[:-1]) | (longer[1:] != longer[:-1]) | (cell[1:] != cell[:-1]) | (bucket[1:] != bucket[:-1])
    sizes = np.diff(np.append(np.flatnonzero(new), len(rows)))
    shared = np.repeat(sizes > 1, sizes)
    order, block, longer, cell, new = order[shared], block[shared], longer[shared], cell[shared], new[shared]
    word, many = rows["word"].to_numpy()[order], rows["n"].to_numpy()[order]
    heads, tails, lengths = matrices(word.tolist())
    starts = np.flatnonzero(new)
    sizes = sizes[sizes > 1]
    split = np.add.reduceat(block, starts) if len(starts) else block  # rows of the second block of a tile
    found: list[tuple[np.ndarray, np.ndarray]] = []
    whole = np.flatnonzero((split == 0) & (sizes <= 1_024))
    for some, at in _stacks(starts[whole], sizes[whole]):
        first = starts[whole[some]]
        x, y = near(heads, tails, lengths, at, at, longer[first], cell[first])
        found.append((x[x < y], y[x < y]))
    for n in np.flatnonzero((split > 0) | (sizes > 1_024)):
        begin, end = starts[n], starts[n] + sizes[n]
        middle = end - split[n] if split[n] else begin
        cut = 1_024
        for i in range(begin, middle if split[n] else end, cut):
            last = min(i + cut, middle if split[n] else end)
            for j in range(middle if split[n] else i, end, cut):
                left, right = np.arange(i, last)[None], np.arange(j, min(j + cut, end))[None]
                x, y = near(heads, tails, lengths, left, right, longer[[begin]], cell[[begin]])
                found.append((x, y) if split[n] else (x[x < y], y[x < y]))
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    return pd.DataFrame({"word": word[a], "near": word[b], "near_n": many[b]})


def near_words(words: DataFrame, total: int, block: int = BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n; ``total`` different words) one edit apart, both ways.

    ``words`` has to be pinned or a file scan.
    """
    length = F.char_length("word")
    keys = []
    for more in (0, 1):  # a word is as long as the longer one of its pair, or one code point shorter
        longer = length + more
        for cell in range(CELLS):
            low, high = (F.floor(longer * n / CELLS).cast("int") for n in (cell, cell + 1))
            shared = F.xxhash64(F.lit(cell), longer, F.left("word", low), F.right("word", longer - high))
            keys.append(F.struct(F.lit(cell).alias("cell"), longer.alias("longer"), shared.alias("bucket")))
    bucket = ["cell", "longer", "bucket"]
    rows = words.select("word", "n", F.explode(F.array(*keys)).alias("_key")).select("_key.*", "word", "n")
    large = pinned(rows.groupBy(*bucket).agg(F.count("*").alias("_many")).filter(F.col("_many") > block))
    listed = large.count() <= LISTED
    rows = rows.join(F.broadcast(large) if listed else large, bucket, "left")
    blocks = F.coalesce(F.ceil(F.col("_many") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tile = F.least("_own", "_other") * F.lit(1 << 31).cast("long") + F.greatest("_own", "_other")
    rows = rows.select(*bucket, tile.alias("tile"), (F.col("_own") > F.col("_other")).cast("int").alias("block"), "word", "n")
    ranges = max(16, -(-4 * total // range_rows))
    ranged = rows.withColumn("_range", F.pmod(F.xxhash64(*bucket, "tile"), F.lit(ranges)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return tiles(rows)

    return ranged.groupBy("_range").applyInPandas(compare, "word string, near string, near_n long")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of ``words`` (word, n; each word once, none empty or null).

    The form is the near word with the largest n, of those the first in code point order, if its n is at least ``ratio``
    times the word's; else null. The root is where following the forms ends. ``ratio`` is at least 2, so counts
    grow with every step and the root is found by doubling, in a number of joins that the largest count bounds.
    """
    if ratio < 2:
        raise ValueError("ratio below 2")
    spark = words.sparkSession
    small_batches(spark, 100_000)
    words = pinned(words.select("word", F.col("n").cast("long").alias("n")))
    total, low, high = words.agg(F.count("*"), F.min("n"), F.max("n")).first()
    links = near_words(words, total, block, range_rows)
    best = F.min(F.struct((-F.col("near_n")).alias("_n"), F.col("near").alias("_near")))
    known = links.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    known = known.select("word", "n_near", F.col("_best._near").alias("_near"), (-F.col("_best._n")).alias("_near_n"))
    joined = words.join(known, "word", "left")
    chosen = F.col("_near_n") >= ratio * F.col("n")
    joined = pinned(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("_near")).alias("form"), F.when(chosen, F.col("_near_n")).alias("form_n"),
        )
    )
    roots = joined.filter("form IS NOT NULL").select(F.col("word").alias("_word"), F.col("form").alias("_root"))
    steps = 1
    while total and low * ratio**steps <= high:  # forms that a chain may have
        ahead = roots.select(F.col("_word").alias("_at"), F.col("_root").alias("_next"))
        roots = roots.join(ahead, F.col("_root") == F.col("_at"), "left")
        roots = pinned(roots.select("_word", F.coalesce("_next", "_root").alias("_root")))
        steps *= 2
    out = joined.join(roots, F.col("word") == F.col("_word"), "left")
    return out.withColumn("root", F.coalesce("_root", "word")).drop("_word", "_root")


def grouped_spellings(docs: DataFrame, **settings) -> DataFrame:
    """``variants`` of the words of ``docs`` with MIN_LENGTH code points and MIN_COUNT occurrences or more.

    Null, empty and letterless texts have no words; equal rows count each; an empty table gives no rows. Only doc_id
    and text are read.
    """
    counts = word_counts(docs).filter((F.char_length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))
    return variants(counts, **settings)
