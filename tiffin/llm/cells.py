"""Sets of a group compared with each other in cells of two tiles.

All pairs of a large group would be rows whose number grows with the square of its size. Here the rows of a group are
dealt to tiles of bounded size, one task at a time holds a pair of tiles, and the sizes of the intersections come from
products of matrices. Only what is made of the pairs leaves the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a tile, about.
TILE_ROWS = 1_024
TILE_BYTES = 8_000_000
#: Numbers in a matrix.
MATRIX = 4_000_000


def in_cells(rows: DataFrame, group: str, row: str, data: str) -> DataFrame:
    """``rows`` with _tile, _low and _high: every pair of rows of a ``group`` meets in one cell (_low, _high).

    Two rows of one tile meet where _low and _high are that tile, others where they are the two tiles. ``row``
    names the row, and ``data`` is what it takes in memory. ``rows`` is read twice and has to be pinned.
    """
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(
        F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum(F.octet_length(data)) / TILE_BYTES)).alias("_tiles")
    )
    dealt = rows.join(sizes, F.col(group) == F.col("_group")).withColumn(
        "_tile", F.pmod(F.xxhash64(F.lit("tile"), row), F.col("_tiles"))
    )
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    cells = met.withColumns({"_low": F.least("_tile", "_other"), "_high": F.greatest("_tile", "_other")})
    return cells.drop("_group", "_tiles", "_other")


class Overlaps:
    """Sizes of the intersections of sets: ``values`` has one after the other, set n from ``at[n]`` to ``at[n + 1]``."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.sizes = np.diff(at)
        owner = np.repeat(np.arange(len(at) - 1), self.sizes)
        _, column, many = np.unique(values, return_inverse=True, return_counts=True)
        met = many[column] > 1  # what only one set has is in no intersection
        order = np.lexsort((column[met], owner[met]))
        self.owner, self.column = owner[met][order], column[met][order]
        self.at = np.searchsorted(self.owner, np.arange(len(at)))

    def _entries(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.at[sets + 1] - self.at[sets]
        first = np.cumsum(counts) - counts
        places = np.repeat(self.at[sets] - first, counts) + np.arange(counts.sum())
        return np.repeat(np.arange(len(sets)), counts), self.column[places]

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A row for each of the sets ``left``, a column for each of ``right``."""
        out = np.zeros((len(left), len(right)), np.int64)
        x, column = self._entries(left)
        names = np.unique(column)
        at_x = np.searchsorted(names, column)
        y, column = self._entries(right)
        here = np.isin(column, names)
        y, at_y = y[here], np.searchsorted(names, column[here])
        width = max(1, MATRIX // max(len(left), len(right), 1))
        for begin in range(0, len(names), width):
            a, b = (np.zeros((len(rows), min(width, len(names) - begin)), np.float32) for rows in (left, right))
            for matrix, row, at in ((a, x, at_x), (b, y, at_y)):
                inside = (at >= begin) & (at < begin + width)
                matrix[row[inside], at[inside] - begin] = 1
            out += (a @ b.T).astype(np.int64)
        return out

    def alike(self, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
        """Whether the Jaccard similarity of each pair is ``percent`` or more."""
        same = self.between(left, right)
        return 100 * same >= percent * (self.sizes[left][:, None] + self.sizes[right][None, :] - same)
