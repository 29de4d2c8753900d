"""Pricing of order requests. A request with one bad line is rejected whole."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.functions import domains
from tiffin.functions.money import AMOUNT
from tiffin.functions.times import order_number
from tiffin.operators.sequences import number_rows
from tiffin.session import pin

Keep = Callable[[DataFrame], DataFrame]
LINE = ["request_id", "pos", "item_id", "quantity"]


class Priced(NamedTuple):
    orders: DataFrame
    lines: DataFrame
    rejects: DataFrame


def request_lines(requests: DataFrame) -> DataFrame:
    """One row per requested line. An item listed twice stays two lines."""
    return requests.select("request_id", F.posexplode("items").alias("pos", "_line")).select(
        "request_id", "pos", "_line.item_id", "_line.quantity"
    )


def _with_prices(lines: DataFrame, menu_items: DataFrame) -> DataFrame:
    """The lines at catalog prices; ``_reason`` says why a line cannot be ordered."""
    catalog = menu_items.select("item_id", "item_name", "price", "is_active").withColumn("_known", F.lit(True))
    bad = F.col("_known").isNull() | (F.coalesce("is_active", F.lit(True)) == F.lit(False))
    label = F.coalesce("item_name", F.col("item_id").cast("string"))
    return lines.join(catalog, "item_id", "left").select(
        *LINE,
        F.col("price").alias("unit_price"),
        (F.col("price") * F.col("quantity")).try_cast(AMOUNT).alias("subtotal"),
        F.when(bad, F.format_string(domains.ITEM_GONE, label)).alias("_reason"),
    )


def _too_large(unpriced: Column) -> Column:
    return F.when((unpriced > 0) | F.col("total_amount").isNull(), domains.NOT_CREATED)


def _settled(headers: DataFrame, verdicts: DataFrame, lines: DataFrame, keep: Keep) -> Priced:
    """Headers with the verdict on their lines, as orders and rejects. A request without lines has no verdict."""
    judged = headers.join(verdicts.withColumn("_judged", F.lit(True)), "request_id", "left")
    no_items = F.when(F.col("_judged").isNull(), domains.MESSAGES["no_items"])
    judged = keep(judged.withColumn("reason", F.coalesce("reason", no_items)))
    accepted = judged.filter("reason IS NULL")
    orders = accepted.select(
        "request_id",
        "user_id",
        order_number(F.col("ts"), F.col("request_id")).alias("order_number"),
        "total_amount",
        "payment_method",
        F.lit("pending").alias("payment_status"),
        F.lit("pending").alias("status"),
        "order_type",
        "scheduled_at",
        F.nullif("special_instructions", F.lit("")).alias("special_instructions"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )
    return Priced(orders, lines, judged.filter("reason IS NOT NULL").select("request_id", "user_id", "reason"))


def price_lines(headers: DataFrame, lines: DataFrame, menu_items: DataFrame) -> Priced:
    """Price flat request lines at catalog prices.

    ``headers``: request_id, user_id, payment_method, special_instructions,
    order_type, scheduled_at, ts. ``lines``: request_id, pos, item_id, quantity.
    A missing or inactive item rejects the request; the first such line by
    position gives the reason. An unavailable item does not reject. A total that
    the order table cannot hold rejects the request as well, and so does a request
    without lines: every request is an order or a reject.
    """
    priced = _with_prices(lines, menu_items)
    sums = priced.groupBy("request_id").agg(
        F.sum("subtotal").try_cast(AMOUNT).alias("total_amount"),
        F.count_if(F.col("subtotal").isNull()).alias("_unpriced"),
        F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.struct("pos", "item_id"))).alias("_reason"),
    )
    reason = F.coalesce("_reason", _too_large(F.col("_unpriced"))).alias("reason")
    verdicts = sums.select("request_id", "total_amount", reason)
    good = verdicts.filter("reason IS NULL").select("request_id")
    return _settled(headers, verdicts, priced.drop("_reason").join(good, "request_id", "left_semi"), lambda df: df)


def price_orders(requests: DataFrame, menu_items: DataFrame, keep: Keep = lambda df: df) -> Priced:
    """Price a batch of valid order requests with nested ``items``, by the rules of ``price_lines``.

    The lines of a request, which came in one row, are judged where they meet again after the look-up, so that they are
    sent once. Of a rejected request only the first is left, which carries the verdict. ``keep`` stores the judged lines
    and requests, for callers that read the results several times.
    """
    inside = Window.partitionBy("request_id").orderBy("pos", "item_id")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    priced = _with_prices(request_lines(requests), menu_items).withColumns(
        {
            "total_amount": F.sum("subtotal").over(whole).try_cast(AMOUNT),
            "_unpriced": F.count(F.when(F.col("subtotal").isNull(), 1)).over(whole),
            "reason": F.first("_reason", ignorenulls=True).over(whole),
            "_first": F.row_number().over(inside) == 1,
        }
    )
    judged = priced.withColumn("reason", F.coalesce("reason", _too_large(F.col("_unpriced"))))
    judged = keep(judged.drop("_reason", "_unpriced").filter("_first OR reason IS NULL"))
    lines = judged.filter("reason IS NULL AND request_id IS NOT NULL").drop("total_amount", "reason", "_first")
    verdicts = judged.filter("_first").select("request_id", "total_amount", "reason")
    return _settled(requests.drop("items"), verdicts, lines, keep)


def with_order_ids(priced: Priced, last_order_id: int, last_line_id: int, keep: Keep | None = None) -> Priced:
    """Give orders and lines consecutive ids in order of arrival.

    Only orders are sorted: the lines of an order follow those of the orders before it, which are counted. ``keep``
    stores the numbered orders, which orders and lines both read.
    """
    counts = priced.lines.groupBy("request_id").agg(F.count("*").alias("_lines"))
    orders = number_rows(
        priced.orders.join(counts, "request_id", "left"),
        [F.col("created_at"), F.col("request_id")],
        "order_id",
        last_order_id,
        keep or pin,
        {"_lines": "_lines_before"},
    )
    orders = (keep or (lambda df: df))(orders.drop("_lines"))
    # pos tells the lines of one request apart
    place = F.row_number().over(Window.partitionBy("request_id", "order_id").orderBy("pos"))
    lines = priced.lines.join(orders.select("request_id", "order_id", "created_at", "_lines_before"), "request_id")
    numbered = lines.withColumn("order_item_id", (F.lit(last_line_id) + F.col("_lines_before") + place).cast("bigint"))
    return Priced(orders.drop("_lines_before"), numbered.drop("_lines_before"), priced.rejects)
