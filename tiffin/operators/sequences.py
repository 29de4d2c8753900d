"""Order inside a key, and row numbers, without sorting a hot key in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.session import pin

# Largest group of rows that one task may have to sort.
MAX_GROUP_ROWS = 5_000_000


def even_slices(df: DataFrame, order: list, keep: Callable[[DataFrame], DataFrame] = pin) -> DataFrame:
    """Adds ``_slice``: consecutive, evenly filled pieces of the (total) order.

    The pieces come from a sampled range sort, so they are pinned, or written by ``keep``: a recomputed
    sample could cut elsewhere.
    """
    return keep(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def number_rows(
    df: DataFrame,
    order: list,
    column: str,
    after: int = 0,
    keep: Callable[[DataFrame], DataFrame] = pin,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Consecutive numbers from ``after + 1`` in the given (total) order.

    ``sums`` names columns and, for each, a new one with its sum over all rows before.
    Only the row count and the sums of each slice meet in one task.
    """
    sums = sums or {}
    sliced = even_slices(df, order, keep)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_slice").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(of: str, window) -> Column:
        return F.coalesce(F.sum(of).over(window), F.lit(0))

    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count("*").alias("_rows"), *[F.sum(of).alias(name) for of, name in sums.items()])
        .select(
            "_slice",
            so_far("_rows", before).alias("_offset"),
            *[so_far(name, before).alias(f"_offset{name}") for name in sums.values()],
        )
    )
    numbers = {column: F.lit(after) + F.col("_offset") + F.row_number().over(inside)}
    numbers |= {name: F.col(f"_offset{name}") + so_far(of, earlier) for of, name in sums.items()}
    # One offset row per shuffle partition: the broadcast is bounded by that number.
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumns({name: number.cast("bigint") for name, number in numbers.items()})
        .drop("_slice", "_offset", *[f"_offset{name}" for name in sums.values()])
    )


def previous_in_order(
    df: DataFrame, key: str, order: list[str], value: str, alias: str, day: Column | None = None
) -> DataFrame:
    """Adds the value of the row before, per key in the given (total) order.

    ``day`` cuts a key into pieces along the order; by default it is the date of the
    first order column. The largest piece is counted first: if it is too large for
    one task, rows are cut into even slices instead.
    """
    boxed = df.withColumns(
        {"_day": day if day is not None else F.to_date(order[0]), "_box": F.struct(F.col(value).alias("v"))}
    )
    largest = boxed.groupBy(key, "_day").agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0]
    if (largest or 0) <= MAX_GROUP_ROWS:
        found = _previous_by_day(boxed, key, order)
    else:
        found = _previous_by_slice(boxed.drop("_day"), key, order)
    return found.withColumn(alias, F.col("_before.v")).drop("_box", "_before")


def _previous_by_day(boxed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Only the first row of each day looks across days: it carries the day's last
    value to the first row of the next one."""
    inside = Window.partitionBy(key, "_day").orderBy(*order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = boxed.withColumns({"_before": F.lag("_box").over(inside), "_last": F.last("_box").over(whole)})
    carried = F.lag("_last").over(Window.partitionBy(key).orderBy("_day"))
    first_of_day = placed.filter("_before IS NULL").withColumn("_before", carried)
    rest = placed.filter("_before IS NOT NULL")
    return rest.unionByName(first_of_day).drop("_day", "_last")


def _previous_by_slice(boxed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each slice looks at the last row of the slice before; there is
    one such row per slice, which bounds the broadcast."""
    total = [key, *order]
    sliced = even_slices(boxed, total)
    row = F.struct(F.col(key).alias("key"), F.col("_box").alias("box"))
    last = sliced.groupBy("_slice").agg(F.max_by(row, F.struct(*total)).alias("_row"))
    carried = last.select("_slice", F.lag("_row").over(Window.orderBy("_slice")).alias("_carried"))
    inside = Window.partitionBy("_slice").orderBy(*total)
    before = F.coalesce(F.lag(row).over(inside), F.col("_carried"))
    return (
        sliced.join(F.broadcast(carried), "_slice")
        .withColumn("_before", before)
        .withColumn("_before", F.when(F.col("_before.key").eqNullSafe(F.col(key)), F.col("_before.box")))
        .drop("_slice", "_carried")
    )
