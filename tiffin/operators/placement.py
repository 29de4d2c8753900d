"""Order placement: requests are checked, priced, numbered and published as one batch."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.operators import pricing
from tiffin.operators.quality import check_order_requests, split
from tiffin.session import Scratch, kept
from tiffin.sources import store


class Placed(NamedTuple):
    orders: DataFrame  # request_id, order_id and the columns of the order table
    lines: DataFrame
    rejects: DataFrame  # request_id, user_id, reason
    events: DataFrame  # the order:new messages


TABLES = Placed._fields


def new_order_messages(orders: DataFrame, users: DataFrame) -> DataFrame:
    """The ``order:new`` message of each placed order; the name is NULL for an unknown user."""
    names = users.select("user_id", "username")
    return orders.join(names, "user_id", "left").select(
        F.lit("order:new").alias("event"),
        F.col("order_id").alias("orderId"),
        F.col("order_number").alias("orderNumber"),
        F.col("total_amount").alias("totalAmount"),
        F.col("user_id").alias("userId"),
        "username",
        F.col("order_type").alias("orderType"),
        F.col("scheduled_at").alias("scheduledAt"),
        F.col("created_at").alias("at"),
    )


def placed_orders(
    requests: DataFrame,
    menu_items: DataFrame,
    users: DataFrame,
    last_order_id: int,
    last_line_id: int,
    keep: pricing.Keep = kept,
) -> Placed:
    """What a batch of order requests comes to. Every request is an order or a reject.

    ``requests``: request_id, user_id, items (item_id, quantity), payment_method,
    special_instructions, order_type, scheduled_at (text), ts. ``keep`` stores what several steps read.
    """
    # Orders, lines, rejects and messages all read the checked requests and the priced lines: each is computed once.
    checked = split(keep(check_order_requests(requests)))
    priced = pricing.price_orders(checked.valid, menu_items, keep)
    refused = checked.rejected.select("request_id", "user_id", F.col("first_error").alias("reason"))
    # From here on, nothing but the rejects would still read the checked requests.
    rejects = keep(refused.unionByName(priced.rejects))
    numbered = pricing.with_order_ids(priced, last_order_id, last_line_id, keep)
    return Placed(numbered.orders, numbered.lines, rejects, new_order_messages(numbered.orders, users))


def place_orders(
    requests: DataFrame,
    menu_items: DataFrame,
    users: DataFrame,
    folder: str,
    batch_id: int,
    last_order_id: int,
    last_line_id: int,
) -> dict[str, DataFrame]:
    """Publish a batch of order requests as one version: readers see all four tables of it or none.

    The batch id is the version, so a batch that is sent again replaces itself; the last
    ids are those before the batch. What is kept on the way goes as soon as no table reads it, all of it at the end.
    """
    spark = requests.sparkSession
    with Scratch(spark) as scratch:
        placed = placed_orders(requests, menu_items, users, last_order_id, last_line_id, scratch)
        scratch.drop_unread(*placed)
        store.publish(placed._asdict(), folder, batch_id)
    return {name: store.current(spark, folder, name, batch_id) for name in TABLES}
