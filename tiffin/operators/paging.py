"""Pages of ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.functions.domains import PAGE_SIZE
from tiffin.operators import sequences
from tiffin.operators.sequences import number_rows

# A top-n passes offset + size rows of every task on to one task; past this bound the
# page is found by day counts.
TOP_ROWS = 1_000
# Spark drops rows beyond a row-number bound before the shuffle up to this bound.
GROUP_LIMIT_ROWS = 1_000


def newest_first() -> list[Column]:
    """Creation dates tie, so the order id decides."""
    return [F.col("created_at").desc(), F.col("order_id").desc()]


def bounds(number: int, size: int) -> tuple[int, int]:
    """First row (from 0) and row count of a page; neither page nor size is below 1."""
    number, size = max(1, int(number)), max(1, int(size))
    return (number - 1) * size, size


def page(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of all rows, newest first."""
    offset, size = bounds(number, size)
    if offset + size <= TOP_ROWS:
        return df.orderBy(*newest_first()).offset(offset).limit(size)
    return _deep_page(df, offset, size)


def _deep_page(df: DataFrame, offset: int, size: int) -> DataFrame:
    """A page far from the start: count rows per day, then sort only its days."""
    span = _day_span(df, [], offset, offset + size)
    # Orders without date are a day of their own, the last one. One row per day bounds the broadcast.
    rows = _joined(df.withColumn("_day", F.to_date("created_at")), F.broadcast(span), ["_day"])
    # All rows of the span start at the same global position, taken from its first day.
    start = span.agg(F.min("_before")).first()[0]
    if start is None:
        return df.limit(0)
    skip = offset - start
    kept = rows.select(*df.columns)
    if skip + size <= TOP_ROWS:
        return kept.orderBy(*newest_first()).offset(skip).limit(size)
    return _page_by_rank(kept, skip, size)


def _page_by_rank(df: DataFrame, offset: int, size: int) -> DataFrame:
    """A page deep inside single days: number rows slice by slice of a range sort."""
    ranked = number_rows(df, newest_first(), "_row")
    return ranked.filter(F.col("_row").between(offset + 1, offset + size)).drop("_row")


def _day_span(df: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Days (per key) that hold the rows low < position <= high, with the rows before them.

    The window runs over day counts, at most one row per calendar day and key.
    """
    days = df.groupBy(*keys, F.to_date("created_at").alias("_day")).agg(F.count("*").alias("_rows"))
    earlier = (
        Window.partitionBy(*keys).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    return days.withColumn("_before", before).filter(
        (F.col("_before") < high) & (F.col("_before") + F.col("_rows") > low)
    )


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys are equal; the keys are those of ``df``."""
    renamed = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(renamed, same).drop(*[f"_of_{k}" for k in keys])


def page_after(df: DataFrame, created_at, order_id: int, size: int = PAGE_SIZE) -> DataFrame:
    """The next page after a given order: a pushed-down filter instead of an offset.

    Orders without date come last; ``created_at`` is None after one of them.
    """
    undated = F.col("created_at").isNull()
    if created_at is None:
        return page(df.filter(undated & (F.col("order_id") < order_id)), 1, size)
    last = F.lit(created_at)
    older = (F.col("created_at") < last) | ((F.col("created_at") == last) & (F.col("order_id") < order_id))
    return page(df.filter(undated | ((F.col("created_at") <= last) & older)), 1, size)


def head(df: DataFrame, rows: int = 5, order: list[Column] | None = None) -> DataFrame:
    """First rows of a total order."""
    return df.orderBy(*(order or newest_first())).limit(rows)


def pages_per_key(df: DataFrame, key: str, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The same page for every key at once, with ``row_number`` inside the key.

    Near the start, each task passes on at most ``offset + size`` rows per key. For
    a later page, day counts per key tell which days hold the page, and rows are
    numbered inside (key, day): one hot key never meets in one task.
    """
    offset, size = bounds(number, size)
    low, high = offset, offset + size
    if high <= GROUP_LIMIT_ROWS:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first()))
        return df.withColumn("row_number", place).filter((F.col("row_number") <= high) & (F.col("row_number") > low))
    span = _day_span(df, [key], low, high)
    rows = _joined(df.withColumn("_day", F.to_date("created_at")), span, [key, "_day"])
    largest = span.agg(F.max("_rows")).first()[0]
    if (largest or 0) <= sequences.MAX_GROUP_ROWS:
        inside = F.row_number().over(Window.partitionBy(key, "_day").orderBy(*newest_first()))
        numbered = rows.withColumn("row_number", F.col("_before") + inside)
    else:
        # A single day of a key is too much for one task: number the rows of all keys
        # at once and count from the first row of each key.
        placed = number_rows(rows, [F.col(key), *newest_first()], "_place")
        starts = placed.groupBy(key).agg(F.min("_place").alias("_start"), F.min("_before").alias("_skipped"))
        numbered = _joined(placed, starts, [key]).withColumn(
            "row_number", F.col("_skipped") + F.col("_place") - F.col("_start") + 1
        )
    return (
        numbered.withColumn("row_number", F.col("row_number").cast("int"))
        .filter(F.col("row_number").between(low + 1, high))
        .select(*df.columns, "row_number")
    )
