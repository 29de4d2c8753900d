"""Sales figures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.functions.money import leading_amount
from tiffin.operators.orders import completed_on, orders_with_status
from tiffin.operators.paging import page

TOP_MARK = 3


def _sales_figures() -> list:
    # order_id is the key, so a plain count is the distinct count; with a single
    # DISTINCT left, rows are not expanded and one hot day is split by customer.
    return [
        F.count("order_id").alias("total_orders"),
        F.countDistinct("user_id").alias("unique_customers"),
        F.sum("total_amount").alias("total_revenue"),
        F.avg("total_amount").alias("avg_order_value"),
    ]


def daily_sales(orders: DataFrame, day: date | None = None) -> DataFrame:
    """Completed orders per day, or of one day (always one row, as a report has)."""
    if day is not None:
        rows = completed_on(orders, day)
        return rows.agg(F.max(F.to_date("created_at")).alias("sale_date"), *_sales_figures())
    rows = orders_with_status(orders, "completed")
    return rows.groupBy(F.to_date("created_at").alias("sale_date")).agg(*_sales_figures())


def top_selling(lines: DataFrame, menu_items: DataFrame, rows: int) -> DataFrame:
    """Items with the most units sold; the item id decides ties."""
    sold = lines.groupBy("item_id").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("subtotal").alias("total_revenue"),
        F.countDistinct("order_id").alias("times_ordered"),
    )
    return (
        sold.join(menu_items.select("item_id", "item_name"), "item_id")
        .select("item_id", "item_name", "total_quantity_sold", "total_revenue", "times_ordered")
        .orderBy(F.col("total_quantity_sold").desc(), "item_id")
        .limit(rows)
    )


def item_units(lines: DataFrame, menu_items: DataFrame, categories: DataFrame) -> DataFrame:
    """Units ordered per item over all time; NULL for an item never ordered."""
    units = lines.groupBy("item_id").agg(F.sum("quantity").alias("total_quantity_ordered"))
    return (
        menu_items.select("item_id", "item_name", "image_url", "category_id")
        .join(units, "item_id", "left")
        .join(categories.select("category_id", "category_name"), "category_id", "left")
        .select("item_id", "item_name", "image_url", "category_name", "total_quantity_ordered")
    )


def _most_ordered_first() -> list:
    return [F.col("total_quantity_ordered").desc_nulls_last(), F.col("item_name"), F.col("item_id")]


def item_order_counts(lines: DataFrame, menu_items: DataFrame, categories: DataFrame) -> DataFrame:
    return item_units(lines, menu_items, categories).orderBy(*_most_ordered_first())


def preparation_ranking(lines: DataFrame, menu_items: DataFrame, categories: DataFrame) -> DataFrame:
    """The same ranking with its first three items marked.

    The three ids are found by a top-n and joined back; numbering all items would
    put them into one task.
    """
    counts = item_units(lines, menu_items, categories)
    first = counts.orderBy(*_most_ordered_first()).limit(TOP_MARK)
    marks = F.broadcast(first.select("item_id", F.lit(True).alias("is_top")))
    return (
        counts.join(marks, "item_id", "left")
        .withColumn("is_top", F.coalesce("is_top", F.lit(False)))
        .orderBy(*_most_ordered_first())
    )


def overview_kpis(orders: DataFrame, menu: DataFrame, scope: str = "all") -> DataFrame:
    """Orders, revenue, pending orders and menu size in one row.

    ``scope="page"`` looks at the first page of orders only, as the dashboard does.
    An amount that is no number counts as 0. ``menu`` holds the rows on the menu.
    """
    if scope not in ("all", "page"):
        raise ValueError("scope is 'all' or 'page'")
    rows = orders if scope == "all" else page(orders, 1)
    amount = F.col("total_amount")
    if not rows.schema["total_amount"].dataType.typeName().startswith("decimal"):
        amount = leading_amount(amount)
    order_part = rows.agg(
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum(F.coalesce(amount, F.lit(0))), F.lit(0)).alias("total_revenue"),
        F.count_if(F.col("status") == "pending").alias("pending_orders"),
        F.lit(0).cast("bigint").alias("menu_items"),
    )
    zero = F.lit(0).cast("bigint")
    menu_part = menu.agg(
        zero.alias("total_orders"),
        F.lit(0).cast(order_part.schema["total_revenue"].dataType).alias("total_revenue"),
        zero.alias("pending_orders"),
        F.count("*").alias("menu_items"),
    )
    both = order_part.unionByName(menu_part)
    return both.agg(*[F.sum(name).alias(name) for name in both.columns])


def cart_totals(cart_lines: DataFrame) -> DataFrame:
    """Price of each user's cart."""
    return cart_lines.groupBy("user_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("cart_total"))


def cart_line_counts(cart_lines: DataFrame) -> DataFrame:
    """Distinct lines in each user's cart, however many units they have."""
    return cart_lines.groupBy("user_id").agg(F.count("*").alias("line_count"))
