"""Nested order documents: one order with its lines as ``items``.

An array must fit one row. A document holds ``max_items`` lines at most; an order is as
many documents, numbered as parts with the same header, as its lines by id need, so
the items of its parts in order are its items. No line is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.functions import domains
from tiffin.functions.money import leading_amount, leading_int, line_subtotal
from tiffin.functions.text import item_label, present
from tiffin.operators.catalog import rows_with_keys
from tiffin.operators.orders import orders_of

# Lines of one document.
MAX_ITEMS = 10_000

CUSTOMER_HEADER = [
    "order_id",
    "order_number",
    "total_amount",
    "payment_method",
    "status",
    "payment_status",
    "special_instructions",
    "created_at",
]
ADMIN_HEADER = [
    "order_id",
    "order_number",
    "user_id",
    "username",
    "full_name",
    "email",
    "phone",
    "total_amount",
    "payment_method",
    "status",
    "payment_status",
    "order_type",
    "scheduled_at",
    "special_instructions",
    "created_at",
    "updated_at",
]


def _quantity(lines: DataFrame) -> Column:
    """Quantity as a whole number, 0 where there is none."""
    if lines.schema["quantity"].dataType.typeName() in ("integer", "long"):
        return F.coalesce("quantity", F.lit(0)).cast("bigint")
    return leading_int(F.col("quantity"))


def _documents(headers: DataFrame, lines: DataFrame, item: Column, max_items: int) -> DataFrame:
    """Headers with ``items``, ``part`` and ``parts``: the items of an order in their order, ``max_items``
    to a part. Orders without lines get ``[]``.

    Lines without id (unmatched outer-join rows) become NULL, which collect_list skips. Parts
    and units are summed over the parts of an order, which are few; all steps use the
    one shuffle by order.
    """
    kept = F.when(F.col("order_item_id").isNotNull(), item)
    order = Window.partitionBy("order_id")
    place = F.row_number().over(order.orderBy("_item"))
    grouped = (
        lines.withColumn("_item", kept)
        .withColumn("part", F.ceil(place / max_items).cast("int"))
        .groupBy("order_id", "part")
        .agg(F.sort_array(F.collect_list("_item")).alias("items"), F.sum("quantity").alias("_part_units"))
        .withColumns({"parts": F.max("part").over(order), "_units": F.sum("_part_units").over(order)})
    )
    empty = F.array().cast(grouped.schema["items"].dataType)
    joined = headers.join(grouped, "order_id", "left")
    one = F.lit(1)
    return joined.withColumns(
        {"items": F.coalesce("items", empty), "part": F.coalesce("part", one), "parts": F.coalesce("parts", one)}
    )


def order_documents(
    orders: DataFrame,
    lines: DataFrame,
    menu_items: DataFrame,
    user_id: int | None = None,
    order_ids: DataFrame | Sequence[int] | None = None,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """Order documents as a customer sees them, of one customer or of all.

    Given both, an order of somebody else gives no document.
    """
    headers = orders if user_id is None else orders_of(orders, [user_id])
    if order_ids is not None:
        headers = rows_with_keys(headers, "order_id", order_ids)
        lines = rows_with_keys(lines, "order_id", order_ids)
    elif user_id is not None:
        lines = lines.join(headers.select("order_id"), "order_id", "left_semi")
    names = menu_items.select("item_id", "item_name", "image_url")
    named = lines.join(names, "item_id", "left")
    item = F.struct("order_item_id", "item_id", "quantity", "unit_price", "subtotal", "item_name", "image_url")
    documents = _documents(headers.select(*CUSTOMER_HEADER), named, item, max_items)
    return documents.select(*CUSTOMER_HEADER, "items", "part", "parts")


def cleaned_lines(lines: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Lines with safe numbers and texts: never NULL quantity, price, subtotal, name or description."""
    described = menu_items.select("item_id", "item_name", "description", "image_url")
    price = leading_amount(F.col("unit_price"), "decimal(10,2)")
    if lines.schema["unit_price"].dataType.typeName() == "decimal":
        price = F.coalesce("unit_price", F.lit(0)).cast("decimal(10,2)")
    name = F.coalesce("item_name_snapshot", "item_name")
    return (
        lines.join(described, "item_id", "left")
        .withColumns({"quantity": _quantity(lines), "unit_price": price})
        .select(
            "order_id",
            "order_item_id",
            "item_id",
            item_label(name, F.col("item_id")).alias("item_name"),
            F.coalesce(present(F.col("description")), F.lit(domains.NO_DESCRIPTION)).alias("description"),
            "quantity",
            F.col("unit_price").alias("price"),
            line_subtotal(F.col("subtotal"), F.col("quantity"), F.col("unit_price")).alias("subtotal"),
            "image_url",
        )
    )


def admin_order_documents(
    orders: DataFrame,
    users: DataFrame,
    lines: DataFrame,
    menu_items: DataFrame,
    order_ids: DataFrame | Sequence[int] | None = None,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """Order documents as an admin sees them: customer, cleaned items and unit count."""
    if order_ids is not None:
        orders = rows_with_keys(orders, "order_id", order_ids)
        lines = rows_with_keys(lines, "order_id", order_ids)
    customer = users.select("user_id", "username", "full_name", "email", "phone")
    headers = orders.join(customer.withColumn("_known", F.lit(True)), "user_id", "left")
    # The document shows the id of the joined user, NULL where there is none.
    headers = headers.withColumn("user_id", F.when(F.col("_known"), F.col("user_id"))).select(*ADMIN_HEADER)
    item = F.struct(
        "order_item_id", "item_id", "item_name", "description", "quantity", "price", "subtotal", "image_url"
    )
    documents = _documents(headers, cleaned_lines(lines, menu_items), item, max_items)
    return documents.withColumn("unit_count_or_zero", F.coalesce("_units", F.lit(0))).select(
        *ADMIN_HEADER, "unit_count_or_zero", "items", "part", "parts"
    )


def order_lines_flat(documents: DataFrame, header: Sequence[str]) -> DataFrame:
    """One row per line again, with the given header columns."""
    return documents.select(*header, F.explode("items").alias("_item")).select(*header, "_item.*")
