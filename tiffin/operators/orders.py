"""Order headers with line figures and customers.

Lines are aggregated before they are joined, which keeps the join at one row per
order. A page is cut before any join: outer joins on unique keys neither add nor
drop orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.functions.domains import PAGE_SIZE
from tiffin.operators.catalog import IN_LIST_LIMIT, rows_with_keys
from tiffin.operators.paging import newest_first, page, pages_per_key
from tiffin.session import pin

FEED = [
    "order_id",
    "order_number",
    "total_amount",
    "payment_method",
    "status",
    "payment_status",
    "order_type",
    "scheduled_at",
    "created_at",
    "user_id",
    "username",
    "full_name",
    "line_count",
]
SUMMARY = [
    "order_id",
    "order_number",
    "total_amount",
    "status",
    "payment_status",
    "created_at",
    "username",
    "full_name",
    "line_count",
]
RECENT = SUMMARY[:6] + ["user_id", "username", "full_name", "email", "line_count"]
UPDATE = [
    "order_id",
    "order_number",
    "user_id",
    "username",
    "full_name",
    "total_amount",
    "status",
    "payment_status",
    "order_type",
    "scheduled_at",
    "created_at",
    "email",
]


def line_figures(lines: DataFrame) -> DataFrame:
    """Per order: number of lines and ordered units."""
    return lines.groupBy("order_id").agg(
        F.count("order_item_id").alias("line_count"), F.sum("quantity").alias("unit_count")
    )


def with_line_figures(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the three line figures.

    ``line_count`` is 0 without lines, ``unit_count`` is NULL without lines, and
    ``unit_count_or_zero`` is its 0 form.
    """
    return (
        orders.join(line_figures(lines), "order_id", "left")
        .withColumn("line_count", F.coalesce("line_count", F.lit(0)))
        .withColumn("unit_count_or_zero", F.coalesce("unit_count", F.lit(0)))
    )


def orders_of(orders: DataFrame, users: DataFrame | Sequence[int]) -> DataFrame:
    return rows_with_keys(orders, "user_id", users)


def orders_with_status(orders: DataFrame, status: str) -> DataFrame:
    return orders.filter(F.col("status") == status)


def completed_on(orders: DataFrame, day: date) -> DataFrame:
    """Completed orders of one day; the day reaches the scan as a timestamp range."""
    return orders_with_status(orders, "completed").filter(F.to_date("created_at") == F.lit(day))


def orders_per_user(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id").agg(F.count("*").alias("order_count"))


def _figures_of_page(orders_page: DataFrame, lines: DataFrame) -> DataFrame:
    """Line figures of one page of orders.

    The page is fixed once. The ids of a short page reach the scan of the lines as a
    filter; a long one is a table to join with.
    """
    rows = pin(orders_page)
    ids = [r[0] for r in rows.select("order_id").limit(IN_LIST_LIMIT + 1).collect()]
    wanted = ids if len(ids) <= IN_LIST_LIMIT else rows
    return with_line_figures(rows, rows_with_keys(lines, "order_id", wanted))


def order_history(orders: DataFrame, lines: DataFrame, users: DataFrame | Sequence[int]) -> DataFrame:
    """All orders of the given customers with their line figures."""
    return with_line_figures(orders_of(orders, users), lines)


def order_history_page(orders: DataFrame, lines: DataFrame, user_id: int, number: int = 1) -> DataFrame:
    """One page of one customer's orders, newest first."""
    rows = page(orders_of(orders, [user_id]), number)
    return _figures_of_page(rows, lines).orderBy(*newest_first())


class PageWithTotal(NamedTuple):
    rows: DataFrame
    total: DataFrame  # user_id, total_count; one row, also if the page is empty


def page_with_total(
    orders: DataFrame, lines: DataFrame, user_id: int, number: int = 1, size: int = PAGE_SIZE
) -> PageWithTotal:
    """A page of the caller's size, and the customer's order count."""
    mine = orders_of(orders, [user_id])
    rows = _figures_of_page(page(mine, number, size), lines).orderBy(*newest_first())
    total = mine.agg(F.count("*").alias("total_count"))
    return PageWithTotal(rows, total.select(F.lit(user_id).cast("bigint").alias("user_id"), "total_count"))


def order_pages(orders: DataFrame, lines: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The same page for all customers at once, with each customer's order count."""
    totals = orders_per_user(orders).withColumnRenamed("order_count", "total_count")
    # Both sides are partitioned by user here, so this join needs no further shuffle.
    rows = pages_per_key(orders, "user_id", number, size).join(totals, "user_id")
    return with_line_figures(rows, lines)


def with_customer(orders: DataFrame, users: DataFrame, *columns: str) -> DataFrame:
    return orders.join(users.select("user_id", *columns), "user_id", "left")


def admin_order_feed(
    orders: DataFrame, users: DataFrame, lines: DataFrame, number: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """One page of all orders with customer and line count."""
    rows = page(orders, number, size)
    named = with_customer(_figures_of_page(rows, lines), users, "username", "full_name")
    return named.select(*FEED).orderBy(*newest_first())


def order_summary(
    orders: DataFrame, users: DataFrame, lines: DataFrame, order_ids: DataFrame | Sequence[int]
) -> DataFrame:
    """Header, customer and line count of the given orders; unknown ids give no row."""
    wanted = rows_with_keys(orders, "order_id", order_ids)
    figures = with_line_figures(wanted, rows_with_keys(lines, "order_id", order_ids))
    return with_customer(figures, users, "username", "full_name").select(*SUMMARY)


def recent_orders(orders: DataFrame, users: DataFrame, lines: DataFrame) -> DataFrame:
    """Every order with customer, e-mail and line count, newest first."""
    figures = with_line_figures(orders, lines)
    return (
        with_customer(figures, users, "username", "full_name", "email").select(*RECENT).orderBy(*newest_first())
    )


def order_update_rows(changed_orders: DataFrame, users: DataFrame) -> DataFrame:
    """Changed orders as the twelve-field update message; orders without user are left out."""
    names = users.select("user_id", "username", "full_name", "email")
    return changed_orders.join(names, "user_id").select(*UPDATE)
