"""Hard negatives by exact integer products of tiles of anchors and candidates, and mergeable heaps.

Vectors become integers. The candidates are written once as tiles, the anchors among them are cut into blocks, and each
block meets each group of tiles in one task. A product of a block and a tile is computed by Strassen's recursion:
both are padded with zeros to even sides, seven products of half-sized combinations replace eight, and all sums and
differences are of 64-bit integers, which wrap, so that only the final scores have to fit 64 bits.

Two passes read the tiles. The first keeps, per anchor, a heap of the best rows of the same label; the second, for each
of these positives, a heap of the best rows of other labels in its window of scores. A heap of one task holds a few
rows, and heaps of several tasks are merged by taking the best of them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiffin.llm.common import pinned, small_batches
from tiffin.llm.jaccard import Packer, Unpacker

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least so many percent of the positive's, and no larger.
LEAST_PERCENT = 80
#: Rows of a tile of candidates, of a block of anchors, and of all tiles that one task takes.
TILE_ROWS = 16_384
BLOCK_ROWS = 8_192
GROUP_ROWS = 131_072
#: Rows and columns of the product that is computed at once.
PART = 2_048
#: A side at which the recursion ends.
LEAF = 16
_EXACT = float(1 << 53)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of two matrices of 64-bit integers by Strassen's recursion, modulo 2^64."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= LEAF:
        bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * inner
        if bound < _EXACT:  # doubles hold every sum of these products as it is
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
        return product(a, b)[:rows, :columns]
    r, k, c = rows // 2, inner // 2, columns // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    out = np.empty((rows, columns), np.int64)
    m = product(a11 + a22, b11 + b22)
    out[:r, :c] = m
    out[r:, c:] = m
    m = product(a21 + a22, b11)
    out[r:, :c] = m
    out[r:, c:] -= m
    m = product(a11, b12 - b22)
    out[:r, c:] = m
    out[r:, c:] += m
    m = product(a22, b21 - b11)
    out[:r, :c] += m
    out[r:, :c] += m
    m = product(a11 + a12, b22)
    out[:r, :c] -= m
    out[:r, c:] += m
    out[r:, c:] += product(a21 - a11, b11 + b12)
    out[:r, :c] += product(a12 - a22, b21 + b22)
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if not values.size or (values.min() >= np.iinfo(kind).min and values.max() <= np.iinfo(kind).max):
            return values.astype(kind)
    return values


class Tile:
    """Rows of vectors by label: key (a number of the row, unique), id, whether it is null, label, vector."""

    def __init__(self, key, ids, null, label, vectors):
        order = np.argsort(label, kind="stable")
        self.key, self.ids, self.null, self.label = key[order], ids[order], null[order], label[order]
        self.vectors = vectors[order]

    def pack(self) -> bytes:
        out, vectors = Packer(), _narrow(self.vectors)
        for part in (self.key, self.ids, self.null, self.label, np.array([self.vectors.shape[1], vectors.itemsize])):
            out.add(part)
        out.add(vectors.ravel())
        return out.done()

    @staticmethod
    def unpack(data: bytes) -> Tile:
        read = Unpacker(data)
        key, ids, null, label = read.get(np.int64), read.get(np.int64), read.get(np.bool_), read.get(np.int64)
        wide, size = read.get(np.int64)
        vectors = read.get(np.dtype(f"<i{size}")).astype(np.int64).reshape(len(key), wide)
        return Tile(key, ids, null, label, vectors)

    def part(self, some) -> Tile:
        return Tile(self.key[some], self.ids[some], self.null[some], self.label[some], self.vectors[some])


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products; the shorter vectors are padded with zeros. Products that may not fit 63 bits fail."""
    wide = max(anchors.shape[1], candidates.shape[1])
    if float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * wide >= 1 << 63:
        raise OverflowError("inner products beyond 63 bits")
    a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (anchors, candidates))
    return product(a, np.ascontiguousarray(b.T))


class Heap:
    """The best ``size`` rows of each of ``owners``: by score, largest first, then by id, null last."""

    def __init__(self, owners: int, size: int):
        self.size, self.rows = size, [np.zeros(0, np.int64)] * 4
        self.counts = np.zeros(owners, np.int64)
        self.least = np.full(owners, np.iinfo(np.int64).min)  # scores below can't enter

    def add(self, owner, score, ids, null) -> None:
        owner, score, ids, null = (
            np.concatenate([old, new]) for old, new in zip(self.rows, (owner, score, ids, null.astype(np.int64)))
        )
        order = np.lexsort((ids, null, -score, owner))
        owner, score, ids, null = owner[order], score[order], ids[order], null[order]
        first = np.searchsorted(owner, owner, "left")
        place = np.arange(len(owner)) - first
        kept = place < self.size
        full = place == self.size - 1
        self.least[owner[full]] = score[full]
        self.rows = [owner[kept], score[kept], ids[kept], null[kept]]


def _wanted(heap: Heap, at: np.ndarray, found: np.ndarray, allowed: np.ndarray):
    """Places (row, column) of a part of the product that may enter the heap of ``at``, one owner a row."""
    allowed &= found >= heap.least[at][:, None]
    if allowed.shape[1] > 8 * heap.size:
        # At least ``size`` of a row are as good as its size-th best score, so lower ones can't enter.
        shown = np.where(allowed, found, np.iinfo(np.int64).min)
        cut = np.partition(shown, allowed.shape[1] - heap.size, axis=1)[:, allowed.shape[1] - heap.size]
        allowed &= found >= cut[:, None]
    return np.nonzero(allowed)


def best_positives(block: Tile, tiles: Iterator[Tile], size: int) -> Heap:
    """Per anchor of ``block``, the best rows of its label among ``tiles`` but itself."""
    heap = Heap(len(block.key), size)
    for tile in tiles:
        for label in np.intersect1d(block.label, tile.label):
            a = np.flatnonzero(block.label == label)
            c = np.flatnonzero(tile.label == label)
            for i in range(0, len(a), PART):
                for j in range(0, len(c), PART):
                    at, of = a[i : i + PART], c[j : j + PART]
                    found = scores(block.vectors[at], tile.vectors[of])
                    x, y = _wanted(heap, at, found, block.key[at][:, None] != tile.key[of])
                    heap.add(at[x], found[x, y], tile.ids[of[y]], tile.null[of[y]])
    return heap


def best_negatives(block: Tile, limits: np.ndarray, tiles: Iterator[Tile], size: int) -> Heap:
    """Per anchor of ``block`` and column of ``limits`` (low and high score), the best rows of other labels within."""
    owners, columns = limits.shape[:2]
    heap = Heap(owners * columns, size)
    lowest, highest = limits[:, :, 0].min(axis=1), limits[:, :, 1].max(axis=1)
    for tile in tiles:
        for i in range(0, owners, PART):
            for j in range(0, len(tile.key), PART):
                at, of = np.arange(i, min(i + PART, owners)), np.arange(j, min(j + PART, len(tile.key)))
                found = scores(block.vectors[at], tile.vectors[of])
                inside = (found >= lowest[at][:, None]) & (found <= highest[at][:, None])
                x, y = np.nonzero(inside & (block.label[at][:, None] != tile.label[of]))
                score, ids, null = found[x, y], tile.ids[of[y]], tile.null[of[y]]
                order = np.lexsort((ids, null, -score, x))
                owner, score, ids, null = at[x[order]], score[order], ids[order], null[order]
                first = np.searchsorted(owner, owner, "left")
                for n in range(columns):
                    own = owner * columns + n
                    fits = (score >= limits[owner, n, 0]) & (score <= limits[owner, n, 1]) & (score >= heap.least[own])
                    before = np.concatenate(([0], np.cumsum(fits)))
                    kept = fits & (before[:-1] - before[first] < size)
                    heap.add(own[kept], score[kept], ids[kept], null[kept])
    return heap


TILES = "tile long, rows long, data binary"


def vector_tiles(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows of ``embeddings`` that take part, as tiles, written once: each row in one tile, with a number of its own.

    ``label`` is moved on by one, modulo 10, where vec_id is a multiple of 7. Components become ``floor(scale * x)``; a
    row whose scaled components don't fit 31 bits fails.
    """
    small_batches(embeddings.sparkSession, 4_096)
    vec_id = F.col("vec_id").cast("long")
    clear = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    rows = embeddings.filter("label IS NOT NULL AND embedding IS NOT NULL").filter(clear).select(
        vec_id.cast("string").alias("vec_id"),  # as text: a batch with null ids would come as floats
        F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held, count = TaskContext.get().partitionId(), 0, [], 0

        def tile(rows: pd.DataFrame) -> pd.DataFrame:
            number = (part << 32) + made
            key = (number << 15) + np.arange(len(rows))
            ids = np.array([0 if i is None else int(i) for i in rows["vec_id"]], np.int64)
            null = rows["vec_id"].isna().to_numpy()
            sizes = np.fromiter((len(v) for v in rows["vector"]), np.int64, len(rows))
            values = np.concatenate([*rows["vector"], np.zeros(0, np.int64)]).astype(np.int64)
            if max(values.max(initial=0), -1 - values.min(initial=0)) >= 1 << 31:
                raise OverflowError("scaled components beyond 31 bits")
            vectors = np.zeros((len(rows), int(sizes.max(initial=0))), np.int64)
            vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = values
            data = Tile(key, ids, null, rows["label"].to_numpy(np.int64), vectors).pack()
            return pd.DataFrame({"tile": [number], "rows": [len(rows)], "data": [data]})

        for batch in batches:
            for n in range(0, len(batch), 4_096):
                held.append(batch.iloc[n : n + 4_096])
                count += len(held[-1])
                if count > TILE_ROWS - 4_096:
                    yield tile(pd.concat(held, ignore_index=True))
                    made, held, count = made + 1, [], 0
        if count:
            yield tile(pd.concat(held, ignore_index=True))

    return pinned(rows.mapInPandas(pack, TILES))


def hard_negatives(
    embeddings: DataFrame,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of all anchors.

    Anchors are the rows of ``embeddings`` (vec_id, embedding, label) whose vec_id is a multiple of 100; what takes part
    and how scores are made, ``vector_tiles`` says. Ties of scores go to the smaller vec_id, null last. Rows of equal
    vec_id are rows of their own, and each anchor among them gives its rows. Shorter vectors are padded with zeros.
    An anchor without positives, or a positive without negatives in its window, gives no rows; neither does an empty table.
    """
    spark = embeddings.sparkSession
    tiles = vector_tiles(embeddings, scale)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                tile = Tile.unpack(data)
                some = np.flatnonzero((tile.ids % 100 == 0) & ~tile.null)
                if len(some):
                    cut = [tile.part(some[n : n + 64]) for n in range(0, len(some), 64)]
                    keys, sizes = [int(t.key[0]) for t in cut], [len(t.key) for t in cut]
                    yield pd.DataFrame({"key": keys, "rows": sizes, "data": [t.pack() for t in cut]})

    anchors = pinned(tiles.mapInPandas(pick, "key long, rows long, data binary"))
    parts, total = tiles.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    n_anchors = anchors.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    blocks = max(1, -(-n_anchors // BLOCK_ROWS))
    groups = max(1, -(-total // GROUP_ROWS), min(parts, spark.sparkContext.defaultParallelism))

    def joined(rows: pd.DataFrame) -> Tile:
        read = [Tile.unpack(data) for data in rows["data"]]
        wide = max(t.vectors.shape[1] for t in read)
        vectors = [np.pad(t.vectors, ((0, 0), (0, wide - t.vectors.shape[1]))) for t in read]
        names = ("key", "ids", "null", "label")
        return Tile(*[np.concatenate([getattr(t, name) for t in read]) for name in names], np.concatenate(vectors))

    def one_block(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": rows["block"].iloc[:1], "anchors": [joined(rows).pack()]})

    of = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    anchors = pinned(anchors.select("*", of).groupBy("block").applyInPandas(one_block, "block int, anchors binary"))
    # Each block meets each group of tiles: blocks and tiles are sent once a partner.
    group = F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int").alias("group")
    candidates = tiles.select(group, "data", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    heap = "anchor long, anchor_id long, place int, id long, score long"

    def rows_of(block: Tile, heap: Heap, columns: int) -> pd.DataFrame:
        owner, score, ids, null = heap.rows
        return pd.DataFrame(
            {
                "anchor": block.key[owner // columns],
                "anchor_id": block.ids[owner // columns],
                "place": (owner % columns).astype(np.int32),
                "id": pd.array(ids, "Int64") if not null.any() else pd.array(np.where(null, None, ids), "Int64"),
                "score": score,
            }
        )

    def find_positives(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or blocks.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in heap.split(", ")])
        block = Tile.unpack(blocks["anchors"].iloc[0])
        return rows_of(block, best_positives(block, map(Tile.unpack, rows["data"]), positives), 1)

    def find_negatives(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or blocks.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in heap.split(", ")])
        block = Tile.unpack(blocks["anchors"].iloc[0])
        limits = np.frombuffer(blocks["limits"].iloc[0], np.int64).reshape(len(block.key), positives, 2)
        found = best_negatives(block, limits, map(Tile.unpack, rows["data"]), negatives)
        return rows_of(block, found, positives)

    def merged(heaps: DataFrame, size: int, into: str) -> DataFrame:
        best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return heaps.withColumn(into, F.row_number().over(best)).filter(F.col(into) <= size)

    meet = ["block", "group"]
    pairs = candidates.groupBy(*meet).cogroup(anchors.select("*", every).groupBy(*meet))
    first = pinned(merged(pairs.applyInPandas(find_positives, heap), positives, "nth"))

    def with_limits(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty:
            return pd.DataFrame(columns=["block", "anchors", "limits"])
        keys = Tile.unpack(blocks["anchors"].iloc[0]).key
        limits = np.empty((len(keys), positives, 2), np.int64)
        limits[:, :, 0], limits[:, :, 1] = 1, 0  # no window
        order = np.argsort(keys)
        at = order[np.searchsorted(keys[order], found["anchor"].to_numpy(np.int64))]
        score = found["score"].to_numpy(np.int64)
        nth = found["nth"].to_numpy(np.int64) - 1
        limits[at, nth, 0], limits[at, nth, 1] = -(-least_percent * score // 100), score
        return pd.DataFrame({"block": blocks["block"], "anchors": blocks["anchors"], "limits": [limits.tobytes()]})

    # Anchors know their block by the tile part they came with.
    keyed = first.join(_blocks_of(anchors), "anchor").groupBy("block")
    limited = pinned(
        anchors.groupBy("block").cogroup(keyed).applyInPandas(with_limits, "block int, anchors binary, limits binary")
    )
    pairs = candidates.groupBy(*meet).cogroup(limited.select("*", every).groupBy(*meet))
    second = merged(pairs.applyInPandas(find_negatives, heap), negatives, "rank")
    chosen = first.select(
        "anchor", (F.col("nth") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return second.join(chosen, ["anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _blocks_of(anchors: DataFrame) -> DataFrame:
    """(anchor, block) of all anchors."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data in zip(batch["block"], batch["anchors"]):
                yield pd.DataFrame({"anchor": Tile.unpack(data).key, "block": np.int32(block)})

    return anchors.mapInPandas(listed, "anchor long, block int")
