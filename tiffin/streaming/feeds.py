"""Who sees which event, and the feed of new orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event names and rooms.
TO_ADMINS = [
    "cart:activity",
    "order:new",
    "order:update",
    "menu:item:add",
    "menu:item:update",
    "category:add",
    "category:update",
]
TO_CUSTOMERS = ["menu:item:add", "menu:item:update"]
REFRESH = "menu:full:refresh"


def route(events: DataFrame) -> DataFrame:
    """One row per event and room it is sent to.

    ``events``: event, user_id, status_sent. The owner hears of an order update only
    if a status was sent; a category update that sent a status makes customers
    reload the menu.
    """
    event = F.col("event")
    status_sent = F.coalesce("status_sent", F.lit(False))

    def to(condition, room, name=event):
        return F.when(condition, F.struct(room.alias("room"), name.alias("event")))

    targets = F.array_compact(
        F.array(
            to(event.isin(TO_ADMINS), F.lit("admins")),
            to(event.isin(TO_CUSTOMERS), F.lit("customers")),
            to((event == "category:update") & status_sent, F.lit("customers"), F.lit(REFRESH)),
            to(
                (event == "order:update") & status_sent & F.col("user_id").isNotNull(),
                F.concat(F.lit("user:"), F.col("user_id").cast("string")),
            ),
        )
    )
    return (
        events.withColumn("_to", F.explode(targets))
        .withColumns({"room": F.col("_to.room"), "event": F.col("_to.event")})
        .drop("_to")
    )


def new_order_feed(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """New orders with the column names of the order table; repeats are dropped.

    Consumers order by ``at`` and ``order_id`` when reading.
    """
    renamed = messages.select(
        F.col("orderId").alias("order_id"),
        F.col("orderNumber").alias("order_number"),
        F.col("totalAmount").alias("total_amount"),
        F.col("userId").alias("user_id"),
        "username",
        F.col("orderType").alias("order_type"),
        F.col("scheduledAt").alias("scheduled_at"),
        "at",
    )
    if renamed.isStreaming:
        return renamed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["order_id"])
    first = F.min_by(F.struct(*renamed.columns), "at")
    return renamed.groupBy("order_id").agg(first.alias("row")).select("row.*")
