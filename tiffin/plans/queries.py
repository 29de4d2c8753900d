"""Every operator as a named query over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.functions import money, text, times
from tiffin.operators import accounts, catalog, changes, documents, limits, orders, placement, pricing, quality, rollups, sales
from tiffin.operators.paging import head, page, page_after
from tiffin.session import kept, shared_dir, tune
from tiffin.sources import audit, logs, store
from tiffin.sources import base_tables as base
from tiffin.sources.events import drain, write_by_room
from tiffin.streaming import carts, connections, feeds, traffic, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Report parameters.
SALES_DAY = date(1998, 10, 3)
EMPTY_DAY = date(1990, 1, 1)
AS_OF = datetime(1998, 10, 4, 12, 0, 0)
ONE_USER = 7
# Buckets of the views that streams keep.
VIEW_BUCKETS = 8
SOME_ORDERS = [1, 2, 3, 5, 8, 13, 999_999_999]


def comparable(df: DataFrame) -> DataFrame:
    """Decimals become doubles once, at the very end, and times lose their (UTC) zone."""
    plain = {"decimal": "double", "timestamp": "timestamp_ntz"}
    kinds = {f.name: plain.get(f.dataType.typeName()) for f in df.schema}
    casts = {name: F.col(name).cast(kind) for name, kind in kinds.items() if kind}
    return df.withColumns(casts) if casts else df


def query(fn):
    """Register ``fn(model, spark, folder)`` under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return comparable(fn(base.model_from_base(spark, folder), spark, folder))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# Catalog ----------------------------------------------------------------------


@query
def categories_all(m, spark, folder):
    return catalog.categories_all(m["categories"])


@query
def active_categories(m, spark, folder):
    return catalog.active_categories(m["categories"])


@query
def items_by_id(m, spark, folder):
    """Active items that somebody put into a cart."""
    keys = base.cart_events(base.events(spark, folder)).select("item_id").distinct()
    return catalog.items_by_id(m["menu_items"], keys).select("item_id", "item_name", "price", "is_available")


@query
def items_in(m, spark, folder):
    """Catalog rows of every item on an open order."""
    open_orders = orders.orders_with_status(m["orders"], "pending")
    wanted = m["order_items"].join(open_orders, "order_id", "left_semi").select("item_id").distinct()
    return catalog.items_in(m["menu_items"], wanted)


@query
def menu_catalog(m, spark, folder):
    return catalog.menu_catalog(m["menu_items"], m["categories"])


@query
def available_menu(m, spark, folder):
    return catalog.available_menu(m["menu_items"], m["categories"])


@query
def item_with_category(m, spark, folder):
    return catalog.item_with_category(m["menu_items"], m["categories"])


@query
def menu_search(m, spark, folder):
    menu = catalog.menu_rows(m["menu_items"], m["categories"])
    return catalog.menu_search(menu, 7, "RING").select("item_id", "category_id", "item_name", "price")


@query
def menu_search_all(m, spark, folder):
    menu = catalog.menu_rows(m["menu_items"], m["categories"])
    return catalog.menu_search(menu, "all", "blue").select("item_id", "category_id", "item_name", "price")


@query
def active_or_unknown_items(m, spark, folder):
    """Every seventh flag is unknown here, and stays on the list."""
    flag = F.when(F.col("item_id") % 7 != 0, F.col("is_active"))
    return catalog.active_or_unknown(m["menu_items"].withColumn("is_active", flag)).select("item_id", "is_active")


@query
def order_button_customer(m, spark, folder):
    return catalog.order_button_state(m["menu_items"], "customer").select("item_id", "button")


@query
def order_button_admin(m, spark, folder):
    return catalog.order_button_state(m["menu_items"], "admin").select("item_id", "button")


@query
def first_menu_items(m, spark, folder):
    menu = catalog.menu_rows(m["menu_items"], m["categories"])
    order = [F.col("category_name"), F.col("item_name"), F.col("item_id")]
    return head(menu, 5, order).select("item_id", "item_name", "category_name", "price", "is_available")


# Accounts ---------------------------------------------------------------------


@query
def user_profiles(m, spark, folder):
    return accounts.user_profiles(m["users"])


@query
def users_per_role(m, spark, folder):
    return accounts.users_per_role(m["users"])


@query
def resolve_users(m, spark, folder):
    """Every event's user signs in: by username, by e-mail, or under an unknown name."""
    key = F.col("event_id")
    name = F.concat(F.lit("Customer_"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    login = (
        F.when(key % 3 == 0, F.concat(F.lit(" "), name))
        .when(key % 3 == 1, F.concat(name, F.lit("@Example.org ")))
        .otherwise(F.concat(F.lit("nobody"), key.cast("string")))
    )
    logins = base.events(spark, folder).select(key.alias("login_id"), login.alias("login"))
    return accounts.resolve_users(m["users"], logins)


# Orders -----------------------------------------------------------------------


@query
def orders_of_customers(m, spark, folder):
    """Orders of all inactive customers."""
    inactive = m["users"].filter(~F.col("is_active"))
    return orders.orders_of(m["orders"], inactive).select("order_id", "user_id", "total_amount", "status")


@query
def pending_orders(m, spark, folder):
    return orders.orders_with_status(m["orders"], "pending").select("order_id", "user_id", "total_amount")


@query
def completed_on_day(m, spark, folder):
    return orders.completed_on(m["orders"], SALES_DAY).select("order_id", "user_id", "total_amount", "created_at")


@query
def line_figures(m, spark, folder):
    """All orders with the three line figures."""
    return orders.with_line_figures(m["orders"].select("order_id"), m["order_items"])


@query
def orders_per_user(m, spark, folder):
    return orders.orders_per_user(m["orders"])


@query
def order_history(m, spark, folder):
    """Orders of all inactive customers with their line figures."""
    inactive = m["users"].filter(~F.col("is_active"))
    return orders.order_history(m["orders"], m["order_items"], inactive)


@query
def order_history_page(m, spark, folder):
    return orders.order_history_page(m["orders"], m["order_items"], ONE_USER)


@query
def page_with_total(m, spark, folder):
    found = orders.page_with_total(m["orders"], m["order_items"], ONE_USER, 2, 3)
    totals = orders.orders_per_user(m["orders"]).withColumnRenamed("order_count", "total_count")
    return found.rows.join(totals, "user_id")


@query
def page_total(m, spark, folder):
    """The count that comes with a page past the end."""
    return orders.page_with_total(m["orders"], m["order_items"], ONE_USER, 10_000, 50).total


@query
def order_pages(m, spark, folder):
    return orders.order_pages(m["orders"], m["order_items"], 2, 5)


@query
def order_pages_by_day(m, spark, folder):
    """A page past the row-number bound, found by day counts: empty keys drop out."""
    from tiffin.operators.paging import pages_per_key

    by_status = m["orders"].select("order_id", "status", "created_at")
    return pages_per_key(by_status, "status", 3, 700)


@query
def admin_order_feed(m, spark, folder):
    return orders.admin_order_feed(m["orders"], m["users"], m["order_items"], 1)


@query
def admin_order_feed_p2(m, spark, folder):
    return orders.admin_order_feed(m["orders"], m["users"], m["order_items"], 2)


@query
def order_page(m, spark, folder):
    return page(m["orders"], 3).select("order_id", "order_number", "total_amount", "created_at")


@query
def order_page_far(m, spark, folder):
    """A page past the top-n bound, found by day counts."""
    return page(m["orders"], 120, 10).select("order_id", "order_number", "created_at")


@query
def order_pages_large(m, spark, folder):
    """A page of more than a thousand rows."""
    return page(m["orders"], 2, 3000).select("order_id", "order_number", "created_at")


@query
def order_page_undated(m, spark, folder):
    """A page near the end, where the orders without date are."""
    dated = F.when(F.col("order_id") % 10 != 0, F.col("created_at"))
    rows = m["orders"].withColumn("created_at", dated)
    return page(rows, rows.count() // 20 - 2, 20).select("order_id", "order_number", "created_at")


@query
def order_page_after(m, spark, folder):
    """The page after a given date and id, without an offset."""
    return page_after(m["orders"], datetime(1999, 1, 16), 2).select("order_id", "order_number", "created_at")


def orders_partly_undated(m):
    return m["orders"].withColumn("created_at", F.when(F.col("order_id") % 10 != 0, F.col("created_at")))


@query
def order_page_after_oldest(m, spark, folder):
    """The page after the orders of all days but the oldest: the rest of the dated ones, then those without date."""
    rows = orders_partly_undated(m)
    oldest = rows.agg(F.min("created_at")).first()[0]
    after = page_after(rows, oldest + timedelta(days=1), 0, 60)
    return after.select("order_id", "order_number", "created_at")


@query
def order_page_after_undated(m, spark, folder):
    """The page after an order without date."""
    return page_after(orders_partly_undated(m), None, 5_000).select("order_id", "order_number", "created_at")


@query
def recent_five(m, spark, folder):
    rows = head(m["orders"], 5)
    return rows.select(
        "order_id", "order_number", money.money_text(F.col("total_amount")).alias("total"),
        text.upper_or(F.col("status"), "pending").alias("status"),
    )


@query
def recent_orders(m, spark, folder):
    return orders.recent_orders(m["orders"], m["users"], m["order_items"])


@query
def order_summary(m, spark, folder):
    return orders.order_summary(m["orders"], m["users"], m["order_items"], SOME_ORDERS)


@query
def order_summary_bulk(m, spark, folder):
    """Summaries of all cancelled orders, by a key table."""
    ids = orders.orders_with_status(m["orders"], "cancelled").select("order_id")
    return orders.order_summary(m["orders"], m["users"], m["order_items"], ids)


@query
def order_update_rows(m, spark, folder):
    changed = m["orders"].filter("status = 'ready'")
    return orders.order_update_rows(changed, m["users"])


@query
def order_labels(m, spark, folder):
    """Every order with the texts that the two order lists show."""
    o = orders.with_customer(m["orders"], m["users"], "username", "full_name")
    as_of = F.lit(AS_OF)
    return o.select(
        "order_id",
        text.display_name(
            F.when(F.col("order_id") % 3 != 0, F.col("full_name")),
            F.when(F.col("order_id") % 3 == 1, F.col("username")),
            F.col("user_id"),
        ).alias("customer"),
        text.upper_or(F.when(F.col("order_id") % 7 != 0, F.col("status")), "pending").alias("status_text"),
        text.upper_or(F.when(F.col("order_id") % 5 != 0, F.col("payment_method")), "N/A").alias("payment_text"),
        text.upper_or(F.when(F.col("order_id") % 9 != 0, F.col("payment_status")), "UNKNOWN").alias("paid_text"),
        text.status_bucket(F.col("status")).alias("bucket"),
        text.status_bucket(F.col("payment_status")).alias("payment_bucket"),
        money.money_text(F.col("total_amount")).alias("amount_text"),
        times.schedule_label(F.col("scheduled_at"), as_of).alias("schedule_text"),
        times.schedule_label_customer(F.col("order_type"), F.col("scheduled_at"), as_of).alias("customer_schedule"),
    )


# Documents --------------------------------------------------------------------


def with_item_counts(docs, header):
    """One row per order with its number of items; a long order has several documents."""
    return docs.groupBy(*header).agg(F.sum(F.size("items")).alias("items"))


@query
def customer_order_lines(m, spark, folder):
    """All customer documents, exploded to their lines."""
    docs = documents.order_documents(m["orders"], m["order_items"], m["menu_items"])
    return documents.order_lines_flat(docs, ["order_id", "order_number", "status"])


@query
def customer_order_documents(m, spark, folder):
    """One customer's documents with the number of lines in each."""
    docs = documents.order_documents(m["orders"], m["order_items"], m["menu_items"], user_id=ONE_USER)
    return with_item_counts(docs, documents.CUSTOMER_HEADER)


@query
def order_documents_parts(m, spark, folder):
    """All documents in parts of two lines, with the ids of the first and last line of each."""
    docs = documents.order_documents(m["orders"], m["order_items"], m["menu_items"], max_items=2)
    ids = F.transform("items", lambda i: i["order_item_id"])
    return docs.filter(F.size("items") > 0).select(
        "order_id", "part", "parts", F.size("items").cast("long").alias("lines"),
        F.get(ids, F.lit(0)).alias("first_id"), F.element_at(ids, -1).alias("last_id"),
    )


@query
def owned_order_documents(m, spark, folder):
    """All completed orders are asked for; only the customer's own give a document."""
    listed = orders.orders_with_status(m["orders"], "completed")
    mine = documents.order_documents(
        m["orders"], m["order_items"], m["menu_items"], user_id=ONE_USER, order_ids=listed
    )
    return with_item_counts(mine, ["order_id"])


@query
def order_lines_flat(m, spark, folder):
    """All admin documents, exploded to their cleaned lines."""
    docs = documents.admin_order_documents(m["orders"], m["users"], m["order_items"], m["menu_items"])
    return documents.order_lines_flat(docs, ["order_number", "username", "unit_count_or_zero"])


@query
def admin_order_headers(m, spark, folder):
    docs = documents.admin_order_documents(m["orders"], m["users"], m["order_items"], m["menu_items"])
    return with_item_counts(docs, [*documents.ADMIN_HEADER, "unit_count_or_zero"])


# Sales ------------------------------------------------------------------------


@query
def daily_sales(m, spark, folder):
    return sales.daily_sales(m["orders"])


@query
def daily_sales_day(m, spark, folder):
    return sales.daily_sales(m["orders"], SALES_DAY)


@query
def daily_sales_empty(m, spark, folder):
    return sales.daily_sales(m["orders"], EMPTY_DAY)


@query
def top_selling(m, spark, folder):
    return sales.top_selling(m["order_items"], m["menu_items"], 10)


@query
def item_order_counts(m, spark, folder):
    return sales.item_order_counts(m["order_items"], m["menu_items"], m["categories"])


@query
def preparation_ranking(m, spark, folder):
    return sales.preparation_ranking(m["order_items"], m["menu_items"], m["categories"])


@query
def overview_kpis_all(m, spark, folder):
    return sales.overview_kpis(m["orders"], catalog.menu_rows(m["menu_items"], m["categories"]))


@query
def overview_kpis_page(m, spark, folder):
    return sales.overview_kpis(m["orders"], catalog.menu_rows(m["menu_items"], m["categories"]), "page")


# Pricing and changes ----------------------------------------------------------


def order_requests(m):
    """Every stored order as a request: header and flat lines."""
    headers = m["orders"].select(
        F.col("order_id").alias("request_id"),
        "user_id",
        "payment_method",
        "special_instructions",
        "order_type",
        "scheduled_at",
        F.col("created_at").alias("ts"),
    )
    lines = m["order_items"].select(
        F.col("order_id").alias("request_id"), F.col("order_item_id").alias("pos"), "item_id", "quantity"
    )
    return headers, lines


@query
def price_orders_valid(m, spark, folder):
    return pricing.price_lines(*order_requests(m), m["menu_items"]).orders


@query
def price_orders_verdicts(m, spark, folder):
    """Every request, as an order or as a reject."""
    priced = pricing.price_lines(*order_requests(m), m["menu_items"])
    return priced.orders.select("request_id").unionByName(priced.rejects.select("request_id"))


@query
def price_orders_lines(m, spark, folder):
    return pricing.price_lines(*order_requests(m), m["menu_items"]).lines


@query
def price_orders_numbered(m, spark, folder):
    """Accepted orders with ids in order of arrival, after the largest stored id."""
    last = m["orders"].agg(F.max("order_id")).first()[0]
    numbered = pricing.with_order_ids(pricing.price_lines(*order_requests(m), m["menu_items"]), last, 0)
    return numbered.orders.select("request_id", "order_id", "total_amount")


@query
def price_orders_rejects(m, spark, folder):
    return pricing.price_lines(*order_requests(m), m["menu_items"]).rejects


def nested_requests(m):
    """Every stored order as a request with nested items, as it is sent."""
    line = F.struct("order_item_id", "item_id", "quantity")
    items = m["order_items"].groupBy("order_id").agg(F.array_sort(F.collect_list(line)).alias("items"))
    return (
        m["orders"]
        .join(items, "order_id", "left")
        .select(
            F.col("order_id").alias("request_id"),
            "user_id",
            F.transform("items", lambda i: F.struct(i["item_id"], i["quantity"])).alias("items"),
            F.when(F.col("order_id") % 10 != 0, F.col("payment_method")).alias("payment_method"),
            "special_instructions",
            "order_type",
            F.when(F.col("order_id") % 16 == 0, "soon").otherwise(F.col("scheduled_at").cast("string")).alias("scheduled_at"),
            F.col("created_at").cast("timestamp").alias("ts"),
        )
    )


def place_all(m, spark, runs=1):
    """All requests as one batch, published ``runs`` times."""
    folder = f"{_run_folder(spark)}/orders"
    for _ in range(runs):
        tables = placement.place_orders(nested_requests(m), m["menu_items"], m["users"], folder, 1, 0, 0)
    return tables


@query
def place_orders_orders(m, spark, folder):
    """Accepted orders, numbered from 1, after the batch was sent twice."""
    placed = place_all(m, spark, runs=2)["orders"]
    return placed.select("request_id", "order_id", "user_id", "order_number", "total_amount", "order_type", "created_at")


@query
def place_orders_lines(m, spark, folder):
    """Lines per placed order."""
    lines = place_all(m, spark)["lines"]
    span = (F.max("order_item_id") - F.min("order_item_id") + 1).alias("id_span")
    return lines.groupBy("request_id", "order_id").agg(
        F.count("*").alias("lines"), F.sum("subtotal").alias("subtotal"), span
    )


@query
def place_orders_rejects(m, spark, folder):
    return place_all(m, spark)["rejects"]


@query
def place_orders_events(m, spark, folder):
    return place_all(m, spark)["events"].drop("event")


def order_changes(m, spark, folder):
    return order_changes_of(base.events(spark, folder))


def order_changes_of(e):
    """One change per event: known, unknown and missing states, some unknown orders."""
    k = F.col("k")
    status = (
        F.when(k % 5 == 0, "ready").when(k % 5 == 1, "cancelled").when(k % 5 == 2, "lost").when(k % 5 == 3, "completed")
    )
    payment = F.when(k % 4 == 0, "paid").when(k % 4 == 1, "refunded").when(k % 4 == 2, "unknown")
    return e.select(
        F.when(F.col("event_id") % 50 == 0, -F.col("event_id") - 1).otherwise(F.col("user_id") * 3 + k).alias("order_id"),
        status.alias("status"),
        payment.alias("payment_status"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


@query
def apply_order_updates(m, spark, folder):
    state = changes.apply_order_updates(m["orders"], order_changes(m, spark, folder)).state
    return state.select("order_id", "status", "payment_status")


@query
def order_update_rejects(m, spark, folder):
    rejected = changes.apply_order_updates(m["orders"], order_changes(m, spark, folder)).rejected
    return rejected.select("seq", "order_id", "reason")


def category_changes(m, spark, folder):
    e = base.events(spark, folder)
    k = F.col("k")
    return e.filter("event_type = 'signup'").select(
        (k % 40).alias("category_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\t Renamed "), k.cast("string"), F.lit("\u00a0")))
        .when(F.col("event_id") % 3 == 1, F.lit(" \t\u00a0"))
        .alias("category_name"),
        F.when(F.col("event_id") % 4 == 0, k % 2 == 0).alias("is_active"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


@query
def category_changes_applied(m, spark, folder):
    changed = changes.apply_category_changes(m["categories"], m["menu_items"], category_changes(m, spark, folder))
    return changed.categories


@query
def category_cascade(m, spark, folder):
    changed = changes.apply_category_changes(m["categories"], m["menu_items"], category_changes(m, spark, folder))
    return changed.menu_items.select("item_id", "category_id", "is_active", "is_available")


@query
def category_change_rejects(m, spark, folder):
    changed = changes.apply_category_changes(m["categories"], m["menu_items"], category_changes(m, spark, folder))
    return changed.rejected.select("seq", "category_id", "reason")


def item_changes(m, spark, folder):
    e = base.events(spark, folder)
    k = F.col("k")
    return e.filter("event_type = 'error'").select(
        (F.col("user_id") * 20 + k - 10).alias("item_id"),
        (k % 4).alias("category_id"),
        F.concat(F.lit("Item "), k.cast("string")).alias("item_name"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.lit("new text")).alias("description"),
        (k + F.lit("0.25").cast("decimal(4,2)")).cast("decimal(10,2)").alias("price"),
        F.when(k % 5 != 0, k % 2 == 0).alias("is_available"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


@query
def update_items(m, spark, folder):
    return changes.update_items(m["menu_items"], item_changes(m, spark, folder)).state


@query
def update_items_rejects(m, spark, folder):
    return changes.update_items(m["menu_items"], item_changes(m, spark, folder)).rejected.select(
        "seq", "item_id", "reason"
    )


@query
def soft_delete_items(m, spark, folder):
    gone = item_changes(m, spark, folder).select("item_id", "at")
    return changes.soft_delete_items(m["menu_items"], gone).state.select("item_id", "is_active", "is_available")


@query
def insert_users(m, spark, folder):
    """Sign-up events: new names, names taken by customers, and repeats in the batch."""
    e = base.events(spark, folder)
    k = F.col("k")
    taken = F.concat(F.lit("CUSTOMER_"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    fresh = F.concat(F.lit("guest_"), (F.col("user_id") * 3 + k).cast("string"))
    signups = e.filter("event_type = 'signup'").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("at"),
        F.when(k % 9 == 0, taken).otherwise(fresh).alias("username"),
        F.concat(F.lit("guest_"), F.col("event_id").cast("string"), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("Guest "), k.cast("string")).alias("full_name"),
        F.lit("").alias("phone"),
        F.lit("staff").alias("role"),
    )
    new = changes.new_users(signups, F.col("at"))
    inserted = changes.insert_rows(m["users"], new, "user_id", ["username", "email"], ["request_id"])
    return inserted.state.select("user_id", "username", "email", "full_name", "phone", "role", "is_active")


def shared_signups(m, spark, folder):
    """Sign-ups that share names with some requests and addresses with others."""
    e = base.events(spark, folder)
    return e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("Visitor_"), F.floor((F.col("event_id") + F.col("k")) / 2).cast("string")).alias("username"),
        F.when(F.col("k") % 13 != 0, F.concat(F.lit("box"), F.floor(F.col("event_id") / 2).cast("string"), F.lit("@x.org"))).alias("email"),
        F.lit("").alias("full_name"),
        F.lit("").alias("phone"),
        F.lit("customer").alias("role"),
        F.col("ts").alias("at"),
    )


@query
def insert_users_rejects(m, spark, folder):
    """Requests refused because an earlier one, accepted before, has their name or address."""
    new = changes.new_users(shared_signups(m, spark, folder), F.col("at"))
    inserted = changes.insert_rows(m["users"], new, "user_id", ["username", "email"], ["request_id"])
    return inserted.rejected.select("request_id", "username", "email")


@query
def insert_items(m, spark, folder):
    """Click events as added items; names of items may repeat."""
    k = F.col("k")
    asked = base.events(spark, folder).filter("event_type = 'click'").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("New dish "), k.cast("string")).alias("item_name"),
        (k % 6).cast("int").alias("category_id"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "tasty").alias("description"),
        (k + F.lit("0.75").cast("decimal(4,2)")).cast("decimal(10,2)").alias("price"),
        F.when(k % 4 == 0, "").otherwise("/img/new").alias("image_url"),
        F.when(k % 5 != 0, k % 2 == 0).alias("is_available"),
        F.col("ts").alias("at"),
    )
    new = changes.new_items(asked, F.col("at"))
    return changes.insert_rows(m["menu_items"], new, "item_id", [], ["request_id"]).state


def asked_categories(spark, folder):
    k = F.col("k")
    return base.events(spark, folder).filter("event_type = 'signup'").select(
        F.col("event_id").alias("request_id"),
        F.when(k % 4 == 0, F.concat(F.lit("BRAND#"), (k % 60).cast("string")))
        .otherwise(F.concat(F.lit("Season "), k.cast("string"))).alias("category_name"),
        F.when(k % 3 != 0, k % 2 == 0).alias("is_active"),
        F.col("ts").alias("at"),
    )


@query
def insert_categories(m, spark, folder):
    """Sign-up events as added categories: new names, stored ones in other case, and repeats."""
    new = changes.new_categories(asked_categories(spark, folder), F.col("at"))
    return changes.insert_rows(m["categories"], new, "category_id", ["category_name"], ["request_id"]).state


@query
def insert_categories_rejects(m, spark, folder):
    new = changes.new_categories(asked_categories(spark, folder), F.col("at"))
    inserted = changes.insert_rows(m["categories"], new, "category_id", ["category_name"], ["request_id"])
    return inserted.rejected.select("request_id", "category_name")


@query
def propagate_deletes_counts(m, spark, folder):
    """Rows left in every table after deleting some users, orders, categories and items."""
    result = changes.propagate_deletes(m, deletions(m)).model
    parts = [
        df.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
        for name, df in result.items()
    ]
    parts.append(
        result["menu_items"].agg(F.count_if(F.col("category_id").isNull()).alias("rows_left"))
        .select(F.lit("menu_items without category").alias("table_name"), "rows_left")
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def deletions(m):
    """Inactive users, cancelled orders, inactive categories and unavailable items."""

    def pick(table, key, condition):
        return m[table].filter(condition).select(F.lit(table).alias("table"), F.col(key).cast("bigint").alias("id"))

    return (
        pick("users", "user_id", "NOT is_active")
        .unionByName(pick("orders", "order_id", "status = 'cancelled'"))
        .unionByName(pick("categories", "category_id", "NOT is_active"))
        .unionByName(pick("menu_items", "item_id", "NOT is_available"))
    )


@query
def propagate_deletes_rejects(m, spark, folder):
    """Items that are still on a line are refused."""
    return changes.propagate_deletes(m, deletions(m)).rejected


# Quality ----------------------------------------------------------------------


@query
def constraint_report(m, spark, folder):
    return quality.constraint_report(m)


@query
def total_reconciliation(m, spark, folder):
    return quality.total_reconciliation(m["orders"], m["order_items"])


@query
def line_reconciliation(m, spark, folder):
    return quality.line_reconciliation(m["order_items"])


def signup_requests(m):
    key = F.col("user_id")
    return m["users"].select(
        key.alias("request_id"),
        F.when(key % 11 == 0, F.concat(F.lit(" "), F.substring("username", 1, 2), F.lit(" ")))
        .when(key % 11 == 1, F.concat(F.col("username"), F.lit("-more")))
        .when(key % 11 == 2, F.concat(F.lit("\t"), F.col("username"), F.lit("\n")))
        .when(key % 11 == 3, F.concat(F.substring("username", 1, 1), F.lit("\t\t")))
        .otherwise(F.col("username"))
        .alias("username"),
        F.when(key % 6 == 0, F.replace("email", F.lit("@"), F.lit("")))
        .when(key % 6 == 1, F.concat(F.lit("o'"), F.col("email")))
        .when(key % 18 == 2, F.concat(F.lit("a.."), F.col("email")))
        .when(key % 18 == 8, F.replace("email", F.lit("@"), F.lit("@-")))
        .otherwise(F.col("email"))
        .alias("email"),
        F.when(key % 8 == 0, "J").when(key % 8 != 1, F.col("full_name")).alias("full_name"),
        F.when(key % 5 == 0, F.lit("call me")).when(key % 5 != 1, F.col("phone")).alias("phone"),
        F.when(key % 4 == 0, "staff").when(key % 4 != 1, F.col("role")).alias("role"),
    )


@query
def signup_errors(m, spark, folder):
    """Every broken rule of every sign-up request."""
    rejected = quality.split(quality.check_signups(signup_requests(m))).rejected
    return rejected.select("request_id", "first_error", F.explode("errors").alias("e")).select(
        "request_id", "first_error", "e.field", "e.message"
    )


@query
def signup_errors_strict(m, spark, folder):
    rejected = quality.split(quality.check_signups(signup_requests(m), "strict")).rejected
    return rejected.select("request_id", "first_error", F.explode("errors").alias("e")).select(
        "request_id", "first_error", "e.field", "e.message"
    )


@query
def signup_valid(m, spark, folder):
    return quality.split(quality.check_signups(signup_requests(m))).valid.select("request_id", "username")


@query
def cap_admins_rejects(m, spark, folder):
    """All customers sign up again where one admin exists; admins past the cap are refused."""
    signups = m["users"].select(F.col("user_id").alias("request_id"), "role", F.col("user_id").alias("ts"))
    one_admin = m["users"].filter("user_id = 0")
    return quality.cap_admins(one_admin, signups).rejected.select("request_id", "first_error")


def item_requests(m):
    key = F.col("item_id")
    return m["menu_items"].select(
        key.alias("request_id"),
        F.when(key % 9 == 0, " ")
        .when(key % 9 == 1, F.repeat("item_name", 12))
        .otherwise(F.col("item_name"))
        .alias("item_name"),
        F.when(key % 8 == 0, "")
        .when(key % 8 == 1, "free")
        .when(key % 8 == 2, "-1.5")
        .otherwise(F.col("price").cast("string"))
        .alias("price"),
        F.when(key % 7 == 0, "x1").otherwise(F.col("category_id").cast("string")).alias("category_id"),
        F.when(key % 6 == 0, F.repeat("item_name", 60)).otherwise(F.col("description")).alias("description"),
        F.when(key % 5 == 0, "yes").when(key % 5 == 1, "true").alias("is_available"),
    )


@query
def item_errors(m, spark, folder):
    rejected = quality.split(quality.check_items(item_requests(m))).rejected
    return rejected.select("request_id", "first_error", F.explode("errors").alias("e")).select(
        "request_id", "first_error", "e.field", "e.message"
    )


@query
def category_errors(m, spark, folder):
    """Category requests named after the items."""
    key = F.col("item_id")
    requests = m["menu_items"].select(
        key.alias("request_id"),
        F.when(key % 9 == 0, " ")
        .when(key % 9 == 1, F.repeat("item_name", 12))
        .otherwise(F.col("item_name"))
        .alias("category_name"),
        F.when(key % 5 == 0, "maybe").when(key % 5 == 1, "true").when(key % 5 == 2, "TRUE").alias("is_active"),
    )
    rejected = quality.split(quality.check_categories(requests)).rejected
    return rejected.select("request_id", "first_error", F.explode("errors").alias("e")).select(
        "request_id", "first_error", "e.field", "e.message"
    )


@query
def order_request_errors(m, spark, folder):
    """Every order as a one-line request, some with a missing or broken part."""
    key = F.col("order_id")
    line = F.struct(
        F.when(key % 11 != 0, key).alias("item_id"), F.when(key % 13 == 0, 0).otherwise(2).alias("quantity")
    )
    requests = m["orders"].select(
        key.alias("request_id"),
        "user_id",
        F.when(key % 17 != 0, F.array(line)).alias("items"),
        F.when(key % 10 != 0, F.col("payment_method")).alias("payment_method"),
        F.when(key % 3 == 0, "later").otherwise(F.col("order_type")).alias("order_type"),
        F.when(key % 16 == 0, "soon")
        .when(key % 20 == 0, "1990-01-01 10:00:00")
        .otherwise(F.col("scheduled_at").cast("string"))
        .alias("scheduled_at"),
        F.col("created_at").cast("timestamp").alias("ts"),
    )
    checked = quality.check_order_requests(requests)
    return quality.split(checked).rejected.select(
        "request_id", "order_type", F.col("errors")[0]["field"].alias("field"), "first_error"
    )


@query
def cart_message_errors(m, spark, folder):
    checked = quality.check_cart_messages(base.cart_payloads(base.events(spark, folder)))
    return quality.split(checked).rejected.select("event_id", "user_id", "payload", "first_error")


@query
def status_anomalies(m, spark, folder):
    found = quality.status_anomalies(base.status_history(spark, folder))
    return found.select("order_id", "seq", "previous", "status", "anomaly")


# Logs, audit rows and feeds -----------------------------------------------------


@query
def access_log_rows(m, spark, folder):
    """Requests written as log lines and read back."""
    r = base.request_log(base.events(spark, folder))
    line = logs.access_log_line(
        text.log_level(F.col("status")), F.col("method"), F.col("path"), F.col("status"), F.col("duration_ms")
    )
    return logs.parse_access_log(r.select("event_id", line.alias("value")))


@query
def audit_changes(m, spark, folder):
    return audit.audit_changes(base.audit_rows(spark, folder)).drop("action", "entity_type")


def changed_fields(before, after, key, entity, spark):
    """What the audit rows of a change from ``before`` to ``after`` say, field by field."""
    rows = audit.capture(before, after, key, entity, F.lit(AS_OF), ONE_USER)
    return audit.audit_changes(rows).select("action", "entity_id", "field", "old_value", "new_value")


@query
def audit_of_order_updates(m, spark, folder):
    after = changes.apply_order_updates(m["orders"], order_changes(m, spark, folder)).state
    kept = m["orders"].drop("updated_at")
    return changed_fields(kept, after.drop("updated_at"), "order_id", "order", spark)


@query
def audit_of_item_updates(m, spark, folder):
    after = changes.update_items(m["menu_items"], item_changes(m, spark, folder)).state
    return changed_fields(m["menu_items"], after, "item_id", "menu_item", spark)


@query
def audit_of_category_changes(m, spark, folder):
    changed = changes.apply_category_changes(m["categories"], m["menu_items"], category_changes(m, spark, folder))
    items = changed_fields(m["menu_items"], changed.menu_items, "item_id", "menu_item", spark)
    return items.unionByName(changed_fields(m["categories"], changed.categories, "category_id", "category", spark))


@query
def cart_activity(m, spark, folder):
    return carts.cart_activity(base.cart_payloads(base.events(spark, folder)), m["users"])


@query
def cart_state_batch(m, spark, folder):
    return carts.cart_lines(base.cart_events(base.events(spark, folder)))


@query
def cart_totals(m, spark, folder):
    lines = carts.cart_lines(base.cart_events(base.events(spark, folder)))
    return sales.cart_totals(carts.priced_cart(lines, m["menu_items"]))


@query
def cart_line_counts(m, spark, folder):
    return sales.cart_line_counts(carts.cart_lines(base.cart_events(base.events(spark, folder))))


@query
def routed_events(m, spark, folder):
    return feeds.route(base.routed_messages(base.events(spark, folder)))


@query
def new_order_feed(m, spark, folder):
    return feeds.new_order_feed(base.new_order_messages(base.events(spark, folder)))


def menu_state(m):
    return m["menu_items"].select("item_id", "item_name", "description", "price", "is_available", "is_active")


@query
def menu_view_customer(m, spark, folder):
    changes_df = base.menu_changes(base.events(spark, folder))
    return views.merge_menu_events(menu_state(m), changes_df, "customer")


@query
def menu_view_admin(m, spark, folder):
    changes_df = base.menu_changes(base.events(spark, folder))
    return views.merge_menu_events(menu_state(m), changes_df, "admin")


@query
def category_view(m, spark, folder):
    return views.merge_category_events(m["categories"], base.category_messages(base.events(spark, folder)))


def order_update_messages(m, spark, folder):
    """Order changes as full update messages."""
    changed = order_changes(m, spark, folder)
    return changed.select(
        "order_id",
        F.concat(F.lit("UPD"), F.col("seq").cast("string")).alias("order_number"),
        "status",
        "payment_status",
        F.col("seq").cast("decimal(12,2)").alias("total_amount"),
        "at",
        "seq",
    )


@query
def order_feed_admin(m, spark, folder):
    state = m["orders"].select("order_id", "order_number", "total_amount", "status", "payment_status", "created_at")
    return views.merge_order_updates(state, order_update_messages(m, spark, folder), "admin")


@query
def order_feed_customer(m, spark, folder):
    state = m["orders"].select("order_id", "order_number", "total_amount", "status", "payment_status", "created_at")
    return views.merge_order_updates(state, order_update_messages(m, spark, folder), "customer")


@query
def rate_violations_batch(m, spark, folder):
    return traffic.rate_violations(base.request_log(base.events(spark, folder)), 1, "15 minutes")


@query
def rate_violations_daily(m, spark, folder):
    return traffic.rate_violations(base.request_log(base.events(spark, folder)), 3, "1 day")


@query
def limit_violations(m, spark, folder):
    """Clients over the configured limits, each limit on the requests it covers, in windows that a client's own
    requests open."""
    requests = base.busy_request_log(base.events(spark, folder))
    covered = {
        "all": requests,
        "sign_in": requests.filter("path LIKE '/api/auth/%'"),
        "order": requests.filter("path = '/api/orders'"),
    }
    parts = [
        limits.limit_violations(rows, name).withColumn("limit_name", F.lit(name)) for name, rows in covered.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def client_windows(m, spark, folder):
    """All windows of two days that the requests of each client open, one after the other."""
    return limits.client_windows(base.request_log(base.events(spark, folder)), "2 days")


@query
def request_metrics_batch(m, spark, folder):
    return traffic.request_metrics(base.request_log(base.events(spark, folder)))


@query
def request_metrics_daily(m, spark, folder):
    """Figures per day and method, merged from the sketches of all routes and quarters of an hour."""
    sketches = traffic.request_sketches(base.request_log(base.events(spark, folder)))
    return traffic.request_figures(traffic.rolled_up(sketches, "day", ("method",)))


@query
def connection_sessions(m, spark, folder):
    return connections.connection_sessions(base.connection_events(base.events(spark, folder)))


# Streams over the same events, run until everything available is read --------------


def _run_folder(spark) -> str:
    return f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}"


@query
def cart_activity_stream(m, spark, folder):
    run = _run_folder(spark)
    stream = carts.cart_activity(base.cart_payloads(base.event_stream(spark, folder, run)), m["users"])
    return drain(stream, run)


@query
def rate_violations_stream(m, spark, folder):
    """Violations in the windows that the watermark has closed."""
    run = _run_folder(spark)
    stream = traffic.rate_violations(base.request_log(base.event_stream(spark, folder, run)), 1, "15 minutes")
    return drain(stream, run)


@query
def request_metrics_stream(m, spark, folder):
    run = _run_folder(spark)
    stream = traffic.request_metrics(base.request_log(base.event_stream(spark, folder, run)))
    return drain(stream, run)


@query
def activity_sessions_stream(m, spark, folder):
    run = _run_folder(spark)
    stream = connections.activity_sessions(base.event_stream(spark, folder, run), "2 hours")
    return drain(stream, run)


@query
def cart_state_stream(m, spark, folder):
    """Carts after all events that are due, folded from the stream."""
    run = _run_folder(spark)
    events = base.cart_events(base.event_stream(spark, folder, run))
    carts.keep_carts(events, f"{run}/state", f"{run}/checkpoint", buckets=VIEW_BUCKETS).awaitTermination()
    return store.current(spark, f"{run}/state", "carts")


@query
def connection_stream(m, spark, folder):
    """Sessions ended by events that are due, folded from the stream."""
    run = _run_folder(spark)
    events = base.connection_events(base.event_stream(spark, folder, run))
    connections.keep_sessions(events, f"{run}/state", f"{run}/checkpoint", buckets=VIEW_BUCKETS).awaitTermination()
    return connections.ended_sessions(spark, f"{run}/state")


@query
def menu_view_stream(m, spark, folder):
    """The customers' menu, kept up to date from the stream of menu events."""
    run = _run_folder(spark)
    views.start_view(menu_state(m), f"{run}/state", "menu", "item_id", VIEW_BUCKETS)

    def merge(state, batch):
        return views.merge_menu_events(state, batch, "customer")

    changes_df = base.menu_changes(base.event_stream(spark, folder, run))
    views.keep_view(
        changes_df, f"{run}/state", "menu", merge, f"{run}/checkpoint", "item_id", VIEW_BUCKETS
    ).awaitTermination()
    return store.current(spark, f"{run}/state", "menu")


@query
def new_order_stream(m, spark, folder):
    """Ids of the new orders; the delay is longer than the events last, so of all repeats one is kept."""
    run = _run_folder(spark)
    stream = feeds.new_order_feed(base.new_order_messages(base.event_stream(spark, folder, run)), "3650 days")
    return drain(stream.select("order_id"), run)


@query
def category_view_stream(m, spark, folder):
    """The categories, kept up to date from the stream of category events."""
    run = _run_folder(spark)
    views.start_view(m["categories"], f"{run}/state", "categories", "category_id", VIEW_BUCKETS)
    messages = base.category_messages(base.event_stream(spark, folder, run))
    merge = views.merge_category_events
    views.keep_view(
        messages, f"{run}/state", "categories", merge, f"{run}/checkpoint", "category_id", VIEW_BUCKETS
    ).awaitTermination()
    return store.current(spark, f"{run}/state", "categories")


@query
def cart_state_keyed(m, spark, folder):
    """Carts of the events that are due, followed per user in the state store."""
    run = _run_folder(spark)
    events = base.cart_events(base.event_stream(spark, folder, run))
    return carts.newest_carts(drain(carts.cart_state(events), run, "update"))


@query
def connection_stream_keyed(m, spark, folder):
    """Sessions ended by events that are due, followed per user in the state store."""
    run = _run_folder(spark)
    return drain(connections.connection_stream(base.connection_events(base.event_stream(spark, folder, run))), run)


@query
def order_feed_stream(m, spark, folder):
    """The customers' order list, kept up to date from the stream of updates."""
    run = _run_folder(spark)
    state = m["orders"].select("order_id", "order_number", "status", "payment_status", "created_at")
    views.start_view(state, f"{run}/state", "orders", "order_id", VIEW_BUCKETS)

    def merge(orders_df, batch):
        return views.merge_order_updates(orders_df, batch, "customer")

    updates = order_changes_of(base.event_stream(spark, folder, run))
    views.keep_view(
        updates, f"{run}/state", "orders", merge, f"{run}/checkpoint", "order_id", VIEW_BUCKETS
    ).awaitTermination()
    return store.current(spark, f"{run}/state", "orders")


@query
def room_sink(m, spark, folder):
    """Events per room and name after writing them by audience."""
    run = _run_folder(spark)
    routed = feeds.route(base.routed_messages(base.event_stream(spark, folder, run)))
    write_by_room(routed, f"{run}/rooms", f"{run}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{run}/rooms")
    return rows.groupBy("audience", "room", "event").agg(F.count("*").alias("events"))


# Sinks, written to the shared folder and read back -----------------------------------


@query
def appended_lines(m, spark, folder):
    """Lines and units per day after appending all lines in day folders."""
    path = f"{_run_folder(spark)}/lines"
    store.append_lines(m["order_items"].withColumn("created_at", F.col("created_at").cast("timestamp")), path, 1)
    rows = spark.read.parquet(path)
    return rows.groupBy("order_date").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))


@query
def compacted_changes(m, spark, folder):
    """Order changes appended by day, then compacted to the last one per order."""
    run = _run_folder(spark)
    store.append_by_day(order_changes(m, spark, folder), f"{run}/log", "at", "change_date")
    log = spark.read.parquet(f"{run}/log").drop("change_date")
    store.compact(log, "order_id", ["at", "seq"], f"{run}/state", "changes", 1)
    return store.current(spark, f"{run}/state", "changes").drop("at")


def kept_totals(m, spark, folder):
    """Folder of totals started from all orders, after the order changes of each quarter and then the deletions.

    Each quarter's changes go to the orders as the quarters before left them. The last two batches are sent twice.
    """
    run = f"{_run_folder(spark)}/totals"
    none = m["order_items"].limit(0)
    rollups.start(
        {
            "sales": rollups.sales_change(m["orders"].limit(0), m["orders"]),
            "items": rollups.items_change(none, m["order_items"]),
        },
        run,
        VIEW_BUCKETS,
    )
    # What several batches read is written once: the changes, the orders that they hit, each batch's own.
    news = kept(order_changes(m, spark, folder).withColumn("_quarter", F.coalesce(F.quarter("at"), F.lit(4))))
    orders = m["orders"].select("order_id", "user_id", "status", "payment_status", "created_at", "total_amount")

    def as_of(orders, quarter):
        return changes.apply_order_updates(orders, news.filter(F.col("_quarter") <= quarter).drop("_quarter")).state

    hit = kept(orders.join(news.select("order_id").distinct(), "order_id", "left_semi"))
    for quarter in range(1, 5):
        ids = news.filter(F.col("_quarter") == quarter).select("order_id").distinct()
        own = kept(hit.join(ids, "order_id", "left_semi"))
        change = kept(rollups.sales_change(as_of(own, quarter - 1), as_of(own, quarter)))
        for _ in range(2 if quarter == 4 else 1):
            rollups.add(spark, {"sales": change}, run, quarter - 1, VIEW_BUCKETS)
    model = {**m, "orders": kept(as_of(orders, 4))}
    left = changes.propagate_deletes(model, deletions(model).filter("table IN ('users', 'orders')")).model
    gone = kept(model["orders"].join(left["orders"].select("order_id"), "order_id", "left_anti"))
    lines = m["order_items"].join(gone.select("order_id"), "order_id", "left_semi")
    change = {"sales": rollups.sales_change(gone, gone.limit(0)), "items": rollups.items_change(lines, none)}
    change = {name: kept(rows) for name, rows in change.items()}
    for _ in range(2):
        rollups.add(spark, change, run, 4, VIEW_BUCKETS)
    return run


@query
def daily_sales_kept(m, spark, folder):
    return rollups.daily_sales(store.current(spark, kept_totals(m, spark, folder), "sales"))


@query
def top_selling_kept(m, spark, folder):
    totals = store.current(spark, kept_totals(m, spark, folder), "items")
    return rollups.top_selling(totals, m["menu_items"], 10)
