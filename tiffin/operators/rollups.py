"""Sales totals that are kept up to date under status changes and deletes.

A batch brings the rows it changes as they were and as they are; their difference is added to the totals. Totals per
day are kept per (day, customer), so that a customer is no longer counted once the last order of the day is gone; orders
per item are counted per batch, which is exact because a batch brings all lines of the orders that it changes. Totals
that fall to nothing are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.operators.orders import orders_with_status
from tiffin.sources import store

#: Keys of the totals; they are published in buckets of the first.
KEYS = {"sales": ["sale_date", "user_id"], "items": ["item_id"]}
#: A total with none of these is nothing.
COUNTS = {"sales": ["total_orders", "amounts"], "items": ["lines"]}


def _signed(column: str) -> Column:
    return F.when(F.col("_gone"), -F.col(column)).otherwise(F.col(column))


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("_gone", F.lit(True)).unionByName(after.withColumn("_gone", F.lit(False)))


def _added(rows: DataFrame, table: str) -> DataFrame:
    """Sum of all rows per key; the columns keep their types, so totals have one schema for ever."""
    keys = KEYS[table]
    sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in keys]
    some = " OR ".join(f"{name} <> 0" for name in COUNTS[table])
    return rows.groupBy(*keys).agg(*sums).filter(some)


def sales_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed orders add to the totals per (sale_date, user_id) of completed ones.

    Orders without date or customer have totals of their own. Orders that stay the same may be among both.
    """
    rows = [
        orders_with_status(orders, "completed").select(
            F.to_date("created_at").alias("sale_date"),
            "user_id",
            F.col("order_id").isNotNull().cast("long").alias("total_orders"),
            F.col("total_amount").isNotNull().cast("long").alias("amounts"),
            F.coalesce("total_amount", F.lit(0).cast(orders.schema["total_amount"].dataType)).alias("total_revenue"),
        )
        for orders in (before, after)
    ]
    sums = [F.sum(_signed(name)).alias(name) for name in ("total_orders", "amounts", "total_revenue")]
    totals = _both(*rows).groupBy("sale_date", "user_id").agg(*sums)
    # A change of the amount alone leaves the counts as they are.
    return totals.filter("total_orders <> 0 OR amounts <> 0 OR total_revenue <> 0")


def items_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed orders add to the totals per item: all lines of those orders, as they were and as they are."""

    def totals(lines: DataFrame) -> DataFrame:
        return lines.groupBy("item_id").agg(
            F.count("*").alias("lines"),
            F.count("quantity").alias("quantities"),
            F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("total_quantity_sold"),
            F.count("subtotal").alias("subtotals"),
            F.coalesce(F.sum("subtotal"), F.lit(0)).alias("total_revenue"),
            F.countDistinct("order_id").alias("times_ordered"),
        )

    both = _both(totals(before), totals(after))
    names = [name for name in both.columns if name not in ("item_id", "_gone")]
    kinds = {f.name: f.dataType for f in both.schema}
    sums = [F.sum(_signed(name)).cast(kinds[name]).alias(name) for name in names]
    return both.groupBy("item_id").agg(*sums).filter(" OR ".join(f"{name} <> 0" for name in names))


def start(changes: dict[str, DataFrame], folder: str, buckets: int = store.BUCKETS) -> None:
    """Publish the totals to start from as version 0: the changes from no rows to all of them."""
    tables = {name: store.Buckets(_added(rows, name), KEYS[name][0], None, buckets) for name, rows in changes.items()}
    store.publish(tables, folder, 0)


def add(
    spark: SparkSession, changes: dict[str, DataFrame], folder: str, batch: int, buckets: int = store.BUCKETS
) -> bool:
    """Add the changes of a batch (numbers from 0, rising) to the published totals; False if it is counted already.

    Only buckets with changed keys are read and written, and all totals switch at once. A batch sent again while it is
    the newest replaces itself from the totals before it; an older one changes nothing.
    """
    newest = store.latest_version(spark, folder)
    if newest is None:
        raise ValueError(f"no totals to add to in {folder}")
    if newest > batch + 1:
        return False
    tables = {}
    kept = {name: rows.persist() for name, rows in changes.items()}
    try:
        for name, rows in kept.items():
            hit = store.touched(rows, KEYS[name][0], buckets)
            before = store.in_buckets(spark, folder, name, batch, hit)
            if before is None:
                raise ValueError(f"no totals {name} to add to in {folder}")
            if hit:
                total = _added(before.select(*rows.columns).unionByName(rows), name)
                # The totals keep the types that they were started with.
                total = total.select(*[F.col(f.name).cast(f.dataType) for f in before.select(*rows.columns).schema])
                tables[name] = store.Buckets(total, KEYS[name][0], hit, buckets)
        if tables:
            store.publish(tables, folder, batch + 1)
    finally:
        for rows in kept.values():
            rows.unpersist()
    return True


def daily_sales(totals: DataFrame) -> DataFrame:
    """``sales.daily_sales`` from the totals of ``sales``: a row per day and customer, not per order."""
    kind = totals.schema["total_revenue"].dataType
    summed = totals.groupBy("sale_date").agg(
        F.sum("total_orders").alias("total_orders"),
        F.count("user_id").alias("unique_customers"),
        F.sum("amounts").alias("_amounts"),
        F.sum("total_revenue").alias("total_revenue"),
    )
    mean = F.col("total_revenue") / F.col("_amounts")
    if kind.typeName() == "decimal":
        mean = mean.cast(f"decimal(38,{kind.scale + 4})")
    any_amount = F.col("_amounts") > 0
    return summed.select(
        "sale_date",
        "total_orders",
        "unique_customers",
        F.when(any_amount, F.col("total_revenue")).alias("total_revenue"),
        F.when(any_amount, mean).alias("avg_order_value"),
    )


def item_totals(totals: DataFrame) -> DataFrame:
    """Units, revenue and orders of every item that is on a line, from the totals of ``items``."""
    return totals.select(
        "item_id",
        F.when(F.col("quantities") > 0, F.col("total_quantity_sold")).alias("total_quantity_sold"),
        F.when(F.col("subtotals") > 0, F.col("total_revenue")).alias("total_revenue"),
        "times_ordered",
    )


def top_selling(totals: DataFrame, menu_items: DataFrame, rows: int) -> DataFrame:
    """``sales.top_selling`` from the totals of ``items``; the item id decides ties."""
    return (
        item_totals(totals)
        .join(menu_items.select("item_id", "item_name"), "item_id")
        .select("item_id", "item_name", "total_quantity_sold", "total_revenue", "times_ordered")
        .orderBy(F.col("total_quantity_sold").desc(), "item_id")
        .limit(rows)
    )
