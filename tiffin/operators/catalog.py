"""Categories and menu items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.functions import domains
from tiffin.functions.text import contains_ci

# Longer id lists become a table and a semi join.
IN_LIST_LIMIT = 1_000


def categories_all(categories: DataFrame) -> DataFrame:
    return categories.orderBy("category_name")


def active_categories(categories: DataFrame) -> DataFrame:
    return categories.filter("is_active").orderBy("category_name")


def rows_with_keys(df: DataFrame, key: str, keys: DataFrame | Sequence[int]) -> DataFrame:
    """Rows whose key is listed. Short lists reach the scan as a pushed-down filter."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_semi")
    if len(keys) <= IN_LIST_LIMIT:
        return df.filter(F.col(key).isin(list(keys)))
    wanted = df.sparkSession.createDataFrame([(k,) for k in keys], f"{key} BIGINT")
    return df.join(wanted, key, "left_semi")


def items_by_id(menu_items: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    """Requested items that are active."""
    return rows_with_keys(menu_items.filter("is_active"), "item_id", keys)


def items_in(menu_items: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    """Requested items in any state, with the columns that pricing reads."""
    return rows_with_keys(menu_items.select("item_id", "price", "is_active", "item_name"), "item_id", keys)


def item_with_category(menu_items: DataFrame, categories: DataFrame) -> DataFrame:
    """Every item; the category name is NULL for an item without category."""
    return menu_items.join(categories.select("category_id", "category_name"), "category_id", "left")


def menu_rows(menu_items: DataFrame, categories: DataFrame) -> DataFrame:
    """Active items of active categories. Items without category are not on the menu."""
    names = categories.filter("is_active").select("category_id", "category_name")
    return menu_items.filter("is_active").join(names, "category_id")


def menu_catalog(menu_items: DataFrame, categories: DataFrame) -> DataFrame:
    return menu_rows(menu_items, categories).orderBy("category_name", "item_name", "item_id")


def available_menu(menu_items: DataFrame, categories: DataFrame) -> DataFrame:
    """Available items of active categories, whether the item is active or not."""
    names = categories.filter("is_active").select("category_id", "category_name")
    return (
        menu_items.filter("is_available")
        .join(names, "category_id")
        .select("item_id", "item_name", "description", "price", "image_url", "category_id", "category_name")
    )


def active_or_unknown(items: DataFrame) -> DataFrame:
    return items.filter(F.coalesce("is_active", F.lit(True)))


def menu_search(items: DataFrame, category: int | str = "all", term: str = "") -> DataFrame:
    """Items of one category (or all) whose name contains the term."""
    found = active_or_unknown(items).filter(contains_ci(F.col("item_name"), term))
    return found if category == "all" else found.filter(F.col("category_id") == int(category))


def order_button_state(items: DataFrame, role: str | None = None) -> DataFrame:
    """Adds ``button``: what the order button of each item says to this role."""
    other_role = F.lit(role is not None and role != "customer")
    button = (
        F.when(~F.col("is_active"), domains.BUTTON_REMOVED)
        .when(~F.coalesce("is_available", F.lit(False)), domains.BUTTON_UNAVAILABLE)
        .when(other_role, domains.BUTTON_CUSTOMERS_ONLY)
        .otherwise(domains.BUTTON_ADD)
    )
    return items.withColumn("button", button)
