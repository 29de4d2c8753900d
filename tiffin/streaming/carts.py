"""Cart activity feed and cart contents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiffin.operators.quality import check_cart_messages, split
from tiffin.sources.store import BUCKETS
from tiffin.streaming.folds import fold_in_order
from tiffin.streaming.ordered import OrderedProcessor


def cart_activity(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Valid ``cart:add`` messages with the user's name. Works on streams and tables."""
    valid = split(check_cart_messages(messages)).valid
    return valid.join(users.select("user_id", "username"), "user_id").select(
        F.lit("cart_add").alias("type"), "user_id", "username", "item_id", "quantity", F.col("ts").alias("at")
    )


ITEM_KEY = ["user_id", "item_id"]


def cart_lines(events: DataFrame, carts: DataFrame | None = None) -> DataFrame:
    """Cart contents after the events: user_id, item_id, quantity.

    ``events``: event_id, ts, user_id, action, item_id, quantity. ``carts``: contents
    before them, none by default. An add gives one unit more, a set changes an item
    that is in the cart, a set of 0 or a remove takes it out, a clear empties the cart.

    Only extreme events matter: the last clear of the user, the last removal of the
    item, its first add after that and its last set. Each is an aggregate joined
    back, so the events of one busy cart need not meet in one task.
    """
    if carts is None:
        carts = events.select(*ITEM_KEY, "quantity").limit(0)
    placed = events.withColumn("_at", F.struct("ts", "event_id"))
    cleared = placed.filter("action = 'clear'").groupBy("user_id").agg(F.max("_at").alias("_cleared"))
    live = (
        placed.filter("action IN ('add', 'set', 'remove')")
        .join(cleared, "user_id", "left")
        .filter(F.col("_cleared").isNull() | (F.col("_at") > F.col("_cleared")))
        .select(*ITEM_KEY, "action", "quantity", "_at")
    )
    taken_out = "action = 'remove' OR (action = 'set' AND quantity <= 0)"
    removed = live.filter(taken_out).groupBy(*ITEM_KEY).agg(F.max("_at").alias("_removed"))
    stayed = (
        carts.join(cleared, "user_id", "left_anti")
        .join(removed, ITEM_KEY, "left_anti")
        .select(*ITEM_KEY, F.col("quantity").alias("_had"))
    )
    kept = (
        live.filter("action = 'add' OR (action = 'set' AND quantity > 0)")
        .join(removed, ITEM_KEY, "left")
        .filter(F.col("_removed").isNull() | (F.col("_at") > F.col("_removed")))
        .drop("_removed")
    )
    is_set = F.col("action") == "set"
    marks = kept.groupBy(*ITEM_KEY).agg(
        F.min(F.when(~is_set, F.col("_at"))).alias("_first_add"),
        F.max(F.when(is_set, F.col("_at"))).alias("_last_set"),
        F.max_by("quantity", F.when(is_set, F.col("_at"))).alias("_set_to"),
    )
    # A set finds the item if it was there before or was added before the set.
    had = F.col("_had").isNotNull()
    found = F.col("_last_set").isNotNull() & (had | F.coalesce(F.col("_last_set") > F.col("_first_add"), F.lit(False)))
    in_cart = (
        marks.join(stayed, ITEM_KEY, "full")
        .filter(had | F.col("_first_add").isNotNull())
        .select(
            *ITEM_KEY,
            F.when(found, F.col("_last_set")).alias("_from"),
            F.when(found, F.col("_set_to")).otherwise(F.coalesce("_had", F.lit(0))).alias("_base"),
        )
    )
    adds = kept.filter(~is_set).select(*ITEM_KEY, "_at").join(in_cart, ITEM_KEY)
    counted = adds.filter(F.col("_from").isNull() | (F.col("_at") > F.col("_from")))
    later = counted.groupBy(*ITEM_KEY).agg(F.count("*").alias("_adds"))
    return in_cart.join(later, ITEM_KEY, "left").select(
        *ITEM_KEY, (F.col("_base") + F.coalesce("_adds", F.lit(0))).cast("int").alias("quantity")
    )


def priced_cart(lines: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Cart lines with catalog prices."""
    return lines.join(menu_items.select("item_id", "price"), "item_id")


def keep_carts(
    events: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes", buckets: int = BUCKETS
) -> StreamingQuery:
    """Stream of cart events folded into the table ``carts``, published in buckets of users."""

    def fold(state: dict[str, DataFrame], due: DataFrame) -> dict[str, DataFrame]:
        return {"carts": cart_lines(due, state.get("carts"))}

    return fold_in_order(events, folder, fold, checkpoint, delay, keyed={"carts": "user_id"}, buckets=buckets)


class CartProcessor(OrderedProcessor):
    """One user's cart. Emits every item whose quantity changed; 0 means gone."""

    waiting_schema = "ts timestamp, event_id bigint, action string, item_id bigint, quantity int"
    output_schema = "user_id bigint, item_id bigint, quantity int, at timestamp"

    def init(self, handle) -> None:
        super().init(handle)
        self.cart = handle.getValueState("cart", "lines array<struct<item_id: bigint, quantity: int>>")

    def fold(self, key, events: list) -> pd.DataFrame | None:
        lines = self.cart.get()
        before = {item: quantity for item, quantity in lines[0]} if lines else {}
        after = dict(before)
        for event in events:
            if event.action == "clear":
                after.clear()
                continue
            # As in the fold: without item, or a set without quantity, an event changes nothing.
            if event.item_id is None or (event.action == "set" and event.quantity is None):
                continue
            if event.action not in ("add", "set", "remove"):
                continue
            item = event.item_id
            if event.action == "add":
                after[item] = after.get(item, 0) + 1
            elif event.action == "remove" or event.quantity <= 0:
                after.pop(item, None)
            elif item in after:
                after[item] = event.quantity
        changed = {i: after.get(i, 0) for i in before.keys() | after.keys() if before.get(i) != after.get(i)}
        if not changed:
            return None
        if after:
            self.cart.update((list(after.items()),))
        else:
            self.cart.clear()
        return pd.DataFrame(
            {
                "user_id": key[0],
                "item_id": list(changed),
                "quantity": list(changed.values()),
                "at": pd.Timestamp(events[-1].ts, unit="us"),
            }
        )


def cart_state(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of cart changes within seconds. The newest row per user and item is the cart.

    State is kept per user in the state store. For a backlog, or where one user may
    send a large share of a micro-batch, use ``keep_carts``.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=CartProcessor(),
            outputStructType=CartProcessor.output_schema,
            outputMode="Update",
            timeMode="EventTime",
        )
    )


def newest_carts(changes: DataFrame) -> DataFrame:
    """Cart contents from the written changes of ``cart_state``."""
    last = F.max_by("quantity", F.struct("batch", "at")).alias("quantity")
    return changes.groupBy("user_id", "item_id").agg(last).filter("quantity > 0")
