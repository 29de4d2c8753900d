"""Changes as pure functions from (current state, changes) to new state.

Several changes of one row in a batch are folded in the order of ``seq``. The
callers publish the results with ``tiffin.sources.store.publish``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.functions import domains
from tiffin.functions.text import trimmed
from tiffin.operators.clashes import first_come
from tiffin.operators.sequences import number_rows
from tiffin.session import pin
from tiffin.sources.store import newest_rows


class Changed(NamedTuple):
    state: DataFrame
    rejected: DataFrame


def last_sent(value: Column, seq: Column) -> Column:
    """Aggregate: the value of the last change that sent one."""
    return F.max_by(value, F.when(value.isNotNull(), seq))


def insert_rows(
    current: DataFrame, new: DataFrame, key: str, unique: list[str], order: list[str]
) -> Changed:
    """Append rows with keys after the largest one, in order of arrival.

    A row is rejected if a unique text is taken, by a stored row or by an accepted
    earlier row of the batch. Names compare without case, accents and trailing
    spaces. ``order`` must be unique per row.
    """
    new = pin(new)
    accepted = pin(first_come(new, unique, order, current)) if unique else new
    rejected = new.join(accepted.select(*order), order, "left_anti")
    last = current.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = number_rows(accepted, [F.col(c) for c in order], key, int(last))
    typed = numbered.withColumn(key, F.col(key).cast(current.schema[key].dataType))
    kept = typed.select(*[c for c in current.columns if c in typed.columns])
    return Changed(current.unionByName(kept, allowMissingColumns=True), rejected)


def new_items(items: DataFrame, as_of: Column) -> DataFrame:
    """Item requests with their defaults: empty texts are NULL, availability must be sent."""
    return items.select(
        *[c for c in items.columns if c not in ("category_id", "description", "image_url", "is_available")],
        F.nullif("category_id", F.lit(0)).alias("category_id"),
        F.nullif("description", F.lit("")).alias("description"),
        F.nullif("image_url", F.lit("")).alias("image_url"),
        F.coalesce("is_available", F.lit(False)).alias("is_available"),
        F.lit(True).alias("is_active"),
        as_of.alias("created_at"),
    )


def new_categories(categories: DataFrame, as_of: Column) -> DataFrame:
    """Category requests with their defaults: active unless sent as false."""
    return categories.withColumns(
        {"is_active": F.coalesce("is_active", F.lit(True)), "created_at": as_of}
    )


def new_users(users: DataFrame, as_of: Column) -> DataFrame:
    """Sign-up requests with their defaults: any role but admin is customer."""
    return users.withColumns(
        {
            "full_name": F.nullif("full_name", F.lit("")),
            "phone": F.nullif("phone", F.lit("")),
            "role": F.when(F.col("role") == "admin", "admin").otherwise("customer"),
            "is_active": F.lit(True),
            "created_at": as_of,
            "updated_at": as_of,
        }
    )


def _unknown(changes: DataFrame, current: DataFrame, key: str, reason: str) -> DataFrame:
    return changes.join(current.select(key), key, "left_anti").withColumn("reason", F.lit(reason))


def update_items(menu_items: DataFrame, changes: DataFrame) -> Changed:
    """Replace category, name, description, price and availability of the given items.

    ``changes``: item_id, category_id, item_name, description, price, is_available,
    at, seq. The image stays. Availability that was not sent becomes false.
    """
    last = newest_rows(changes, "item_id", ["seq"]).select(
        "item_id",
        F.struct(
            F.nullif("category_id", F.lit(0)).alias("category_id"),
            "item_name",
            F.nullif("description", F.lit("")).alias("description"),
            "price",
            F.coalesce("is_available", F.lit(False)).alias("is_available"),
            F.col("at").alias("updated_at"),
        ).alias("_new"),
    )
    state = menu_items.join(last, "item_id", "left")
    for field in ["category_id", "item_name", "description", "price", "is_available", "updated_at"]:
        if field in menu_items.columns:
            kind = menu_items.schema[field].dataType
            new = F.col(f"_new.{field}").cast(kind)
            state = state.withColumn(field, F.when(F.col("_new").isNotNull(), new).otherwise(F.col(field)))
    return Changed(
        state.select(*menu_items.columns), _unknown(changes, menu_items, "item_id", "Menu item not found")
    )


def soft_delete_items(menu_items: DataFrame, deletes: DataFrame) -> Changed:
    """Deactivate the given items. An item that is inactive already is no error."""
    gone = deletes.groupBy("item_id").agg(F.max("at").alias("_at"))
    hit = F.col("_at").isNotNull()
    state = menu_items.join(gone, "item_id", "left").withColumn("is_active", F.col("is_active") & ~hit)
    if "updated_at" in menu_items.columns:
        stamp = F.col("_at").cast(menu_items.schema["updated_at"].dataType)
        state = state.withColumn("updated_at", F.coalesce(stamp, "updated_at"))
    return Changed(
        state.select(*menu_items.columns), _unknown(deletes, menu_items, "item_id", "Menu item not found")
    )


class CategoryChanged(NamedTuple):
    categories: DataFrame
    menu_items: DataFrame
    rejected: DataFrame


def apply_category_changes(categories: DataFrame, menu_items: DataFrame, changes: DataFrame) -> CategoryChanged:
    """Rename or switch categories; a sent status also switches all their items.

    ``changes``: category_id, category_name, is_active, at, seq; NULL means not
    sent. A switched-on category switches on every item, also those removed one by
    one before. Publish both tables in one version.
    """
    name = F.nullif(trimmed(F.col("category_name")), F.lit(""))
    sent = changes.withColumn("_name", name)
    usable = F.col("_name").isNotNull() | F.col("is_active").isNotNull()
    folded = (
        sent.filter(usable)
        .groupBy("category_id")
        .agg(
            last_sent(F.col("_name"), F.col("seq")).alias("_name"),
            last_sent(F.col("is_active"), F.col("seq")).alias("_active"),
            F.max("at").alias("_at"),
            F.max(F.when(F.col("is_active").isNotNull(), F.col("at"))).alias("_cascade_at"),
        )
    )
    new_categories_df = categories.join(folded, "category_id", "left").withColumns(
        {
            "category_name": F.coalesce("_name", "category_name"),
            "is_active": F.coalesce("_active", "is_active"),
        }
    )
    known = folded.join(categories.select("category_id"), "category_id", "left_semi")
    cascade = known.filter("_active IS NOT NULL").select("category_id", "_active", "_cascade_at")
    new_items_df = menu_items.join(cascade, "category_id", "left").withColumns(
        {
            "is_active": F.coalesce("_active", "is_active"),
            "is_available": F.coalesce("_active", "is_available"),
        }
    )
    if "updated_at" in categories.columns:
        stamp = F.col("_at").cast(categories.schema["updated_at"].dataType)
        new_categories_df = new_categories_df.withColumn("updated_at", F.coalesce(stamp, "updated_at"))
    if "updated_at" in menu_items.columns:
        stamp = F.col("_cascade_at").cast(menu_items.schema["updated_at"].dataType)
        new_items_df = new_items_df.withColumn("updated_at", F.coalesce(stamp, "updated_at"))
    rejected = (
        sent.filter(~usable)
        .withColumn("reason", F.lit("No valid fields to update"))
        .unionByName(_unknown(sent.filter(usable), categories, "category_id", "Category not found"))
        .drop("_name")
    )
    return CategoryChanged(
        new_categories_df.select(*categories.columns), new_items_df.select(*menu_items.columns), rejected
    )


def apply_order_updates(orders: DataFrame, changes: DataFrame) -> Changed:
    """Set status and payment status; any known state may follow any other.

    ``changes``: order_id, status, payment_status, at, seq. An unknown state is
    ignored; a change without a valid field, or for an unknown order, is rejected.
    """
    status = F.when(F.col("status").isin(domains.ORDER_STATUSES), F.col("status"))
    payment = F.when(F.col("payment_status").isin(domains.PAYMENT_STATUSES), F.col("payment_status"))
    checked = changes.withColumns({"_status": status, "_payment": payment})
    usable = F.col("_status").isNotNull() | F.col("_payment").isNotNull()
    folded = (
        checked.filter(usable)
        .groupBy("order_id")
        .agg(
            last_sent(F.col("_status"), F.col("seq")).alias("_status"),
            last_sent(F.col("_payment"), F.col("seq")).alias("_payment"),
            F.max("at").alias("_at"),
        )
    )
    state = orders.join(folded, "order_id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "payment_status": F.coalesce("_payment", "payment_status"),
        }
    )
    if "updated_at" in orders.columns:
        stamp = F.col("_at").cast(orders.schema["updated_at"].dataType)
        state = state.withColumn("updated_at", F.coalesce(stamp, "updated_at"))
    rejected = (
        checked.filter(~usable)
        .withColumn("reason", F.lit("No valid fields provided for update"))
        .unionByName(_unknown(checked.filter(usable), orders, "order_id", "Order not found"))
        .drop("_status", "_payment")
    )
    return Changed(state.select(*orders.columns), rejected)


class Deleted(NamedTuple):
    model: dict[str, DataFrame]
    rejected: DataFrame


def propagate_deletes(model: dict[str, DataFrame], deletes: DataFrame) -> Deleted:
    """Delete rows and follow the foreign keys.

    ``deletes``: table, id. A user takes the orders along, an order its lines; a
    category leaves its items without category; an item that is still on a line
    stays and is rejected. Audit rows stay and lose their user.
    """

    def ids(table: str, key: str) -> DataFrame:
        wanted = deletes.filter(F.col("table") == table)
        return wanted.select(F.col("id").cast(model[table].schema[key].dataType).alias(key)).distinct()

    result = dict(model)
    gone_users = ids("users", "user_id")
    gone_orders = (
        model["orders"].join(gone_users, "user_id", "left_semi").select("order_id").union(ids("orders", "order_id"))
    ).distinct()
    result["users"] = model["users"].join(gone_users, "user_id", "left_anti")
    result["orders"] = model["orders"].join(gone_orders, "order_id", "left_anti")
    result["order_items"] = model["order_items"].join(gone_orders, "order_id", "left_anti")
    if "audit_logs" in model:
        result["audit_logs"] = _without_parent(model["audit_logs"], gone_users, "user_id")
    gone_categories = ids("categories", "category_id")
    result["categories"] = model["categories"].join(gone_categories, "category_id", "left_anti")
    asked = ids("menu_items", "item_id")
    # Reduce the lines to their item ids before looking the few deleted ones up.
    in_use = result["order_items"].join(asked, "item_id", "left_semi").select("item_id").distinct()
    kept_items = model["menu_items"].join(asked.join(in_use, "item_id", "left_anti"), "item_id", "left_anti")
    result["menu_items"] = _without_parent(kept_items, gone_categories, "category_id")
    rejected = in_use.select(
        F.lit("menu_items").alias("table"),
        F.col("item_id").alias("id"),
        F.lit("Item is used by order lines").alias("reason"),
    )
    return Deleted({name: result[name] for name in model}, rejected)


def _without_parent(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Set the key to NULL on rows whose parent is gone."""
    marked = df.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*df.columns)
