"""Catalog semantics and scalar functions, one test per easily missed rule."""

from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from tests.conftest import NOW, rows_of
from tiffin.functions import money, text, times
from tiffin.operators import accounts, catalog, documents, orders
from tiffin.sources.audit import audit_changes
from tiffin.sources.logs import parse_access_log
from tiffin.sources.model import as_flag


def menu(make, *rows):
    return make(
        "item_id BIGINT, category_id INT, item_name STRING, description STRING, price DECIMAL(10,2), image_url STRING, "
        "is_available BOOLEAN, is_active BOOLEAN",
        *[(n, c, name, None, D("1.00"), None, available, active) for n, c, name, available, active in rows],
    )


def categories(make):
    return make("category_id INT, category_name STRING, is_active BOOLEAN", (1, "A", True), (2, "B", False))


def test_menu_and_available_menu_differ(make):
    items = menu(
        make,
        (1, 1, "on both", True, True),
        (2, 1, "inactive", True, False),
        (3, 1, "unavailable", False, True),
        (4, 2, "off category", True, True),
        (5, None, "no category", True, True),
    )
    assert rows_of(catalog.menu_catalog(items, categories(make)), "item_id") == [(1,), (3,)]
    assert rows_of(catalog.available_menu(items, categories(make)), "item_id") == [(1,), (2,)]
    assert catalog.item_with_category(items, categories(make)).count() == 5


def test_search_treats_wildcards_as_text(make):
    items = menu(make, (1, 1, "100% Juice", True, True), (2, 1, "Juice", True, None), (3, 1, "juice", True, False))
    assert rows_of(catalog.menu_search(items, "all", "%"), "item_id") == [(1,)]
    assert rows_of(catalog.menu_search(items, 1, "JUICE"), "item_id") == [(1,), (2,)]
    assert catalog.menu_search(items, 2, "").count() == 0


def test_button_texts_in_order(make):
    items = menu(make, (1, 1, "a", False, False), (2, 1, "b", None, True), (3, 1, "c", True, None))

    def texts(role):
        return [r.button for r in catalog.order_button_state(items, role).orderBy("item_id").collect()]

    assert texts("customer") == texts(None) == ["Removed", "Unavailable", "Add to Cart"]
    assert texts("admin") == ["Removed", "Unavailable", "Customers Only"]


def test_item_lookup_by_list_and_by_table(make):
    items = menu(make, (1, 1, "a", True, True), (2, 1, "b", True, False))
    assert rows_of(catalog.items_by_id(items, [1, 2]), "item_id") == [(1,)]
    assert catalog.items_in(items, list(range(5_000))).count() == 2
    assert catalog.items_in(items, make("item_id BIGINT", (2,), (2,))).count() == 1


def test_username_wins_over_email(make):
    users = make(
        "user_id BIGINT, username STRING, email STRING, role STRING, full_name STRING",
        (1, "ann", "bob", "customer", None),
        (2, "bob", "bob@x.org", "customer", None),
    )
    logins = make("login_id BIGINT, login STRING", (1, "BOB "), (2, "bob@X.org"), (3, "eve"), (4, " "))
    found = accounts.resolve_users(users, logins)
    assert rows_of(found, "login_id", "user_id", "matched_on") == [(1, 2, "username"), (2, 2, "email")]


def test_line_figures_differ_without_lines(make):
    heads = make("order_id BIGINT", (1,), (2,))
    lines = make("order_item_id BIGINT, order_id BIGINT, quantity INT", (1, 1, 3), (2, 1, 4))
    assert rows_of(orders.with_line_figures(heads, lines)) == [(1, 2, 7, 7), (2, 0, None, 0)]


def test_admin_document_cleans_lines(spark, seed, make):
    lines = make(
        "order_item_id BIGINT, order_id BIGINT, item_id BIGINT, quantity INT, unit_price DECIMAL(10,2), "
        "subtotal DECIMAL(12,2), item_name_snapshot STRING",
        (1, 1, 1, 2, D("8.99"), D("0.00"), None),
        (2, 1, 99, None, None, None, None),
        (3, 1, 2, 1, D("9.99"), D("5.00"), ""),
    )
    doc = documents.admin_order_documents(
        seed["orders"], seed["users"], lines, seed["menu_items"], order_ids=[1]
    ).first()
    shown = [(i.item_name, i.description, i.quantity, i.price, i.subtotal) for i in doc["items"]]
    assert shown == [
        ("Classic Burger", "No description available.", 2, D("8.99"), D("17.98")),
        ("Item Not Found (ID: 99)", "No description available.", 0, D("0.00"), D("0.00")),
        ("Item Not Found (ID: 2)", "No description available.", 1, D("9.99"), D("5.00")),
    ]
    assert doc.unit_count_or_zero == 3


def test_long_orders_are_split_without_loss(spark, seed, make):
    heads = seed["orders"]
    lines = spark.range(1, 1001).selectExpr(
        "id AS order_item_id", "CASE WHEN id <= 990 THEN 1 ELSE 2 END AS order_id", "id % 10 + 1 AS item_id",
        "1 AS quantity", "CAST(1 AS DECIMAL(10,2)) AS unit_price", "CAST(1 AS DECIMAL(12,2)) AS subtotal",
    )
    docs = documents.order_documents(heads, lines, seed["menu_items"], max_items=100).collect()
    parts = {(r.order_id, r.part): (r.parts, [i.order_item_id for i in r["items"]]) for r in docs}
    long = [parts[1, n][1] for n in range(1, 11)]
    assert sum(long, []) == list(range(1, 991)) and max(map(len, long)) == 100
    assert parts[(2, 1)] == (1, list(range(991, 1001))) and parts[(3, 1)] == (1, [])
    assert {p for (order, _), (p, _) in parts.items() if order == 1} == {10}
    admin = documents.admin_order_documents(
        heads, seed["users"], lines.withColumn("item_name_snapshot", F.lit(None).cast("string")), seed["menu_items"], max_items=100
    ).collect()
    assert {(r.order_id, r.unit_count_or_zero) for r in admin} == {(1, 990), (2, 10), (3, 0)}
    assert sum(len(r["items"]) for r in admin) == 1000


def test_number_texts(spark):
    rows = spark.createDataFrame([("12.345abc",), ("abc",), (None,), ("7",), (" 3.5",)], "v STRING")
    got = rows.select(
        money.money_text(F.col("v")).alias("m"), money.leading_int(F.col("v")).alias("i")
    ).collect()
    assert [(r.m, r.i) for r in got] == [("12.35", 12), ("0.00", 0), ("0.00", 0), ("7.00", 7), ("3.50", 3)]


def test_labels(spark):
    one = spark.range(1)
    at = F.lit(datetime(2024, 3, 10, 15, 5))
    day, other = F.lit(NOW), F.lit(datetime(2024, 3, 9, 23, 59))
    null = F.lit(None).cast("timestamp")
    row = one.select(
        times.schedule_label(at, day).alias("a"),
        times.schedule_label(at, other).alias("b"),
        times.schedule_label(null, day).alias("c"),
        times.schedule_label_customer(F.lit("scheduled"), at, other).alias("d"),
        times.schedule_label_customer(F.lit("asap"), at, day).alias("e"),
        times.utc_seconds(F.lit("2024-03-10T15:05:09.999Z")).alias("f"),
        times.days_before(day, 7).alias("g"),
        text.display_name(F.lit(""), F.lit(None).cast("string"), F.lit(7)).alias("h"),
        text.clean_email(F.lit(" A@B.Org ")).alias("i"),
        text.log_level(F.lit(399)).alias("j"),
        text.upper_or(F.lit(""), "asap").alias("k"),
        text.status_bucket(F.lit("nothing")).alias("l"),
    ).first()
    assert list(row) == [
        "Today @ 03:05 PM", "Mar 10 @ 03:05 PM", "N/A", "Scheduled for Mar 10 at 03:05 PM", "ASAP",
        datetime(2024, 3, 10, 15, 5, 9), datetime(2024, 3, 3, 12), "User #7", "a@b.org", "INFO", "ASAP", "other",
    ]


def test_flags_in_all_their_forms(spark):
    rows = spark.createDataFrame([("0",), ("1",), ("true",), ("false",), (None,)], "v STRING")
    assert [r.v for r in rows.select(as_flag(F.col("v")).alias("v")).collect()] == [False, True, True, False, None]


def test_access_log_lines(make):
    lines = make("value STRING", ("[ERROR] GET /api/menu/9 - 404 - 12ms",), ("Server running",), ("[INFO] PUT /a b - 200 - 1ms",))
    assert rows_of(parse_access_log(lines)) == [("ERROR", "GET", "/api/menu/9", 404, 12)]


def test_audit_rows_list_changed_fields(make):
    log = make(
        "log_id BIGINT, user_id BIGINT, action STRING, entity_type STRING, entity_id BIGINT, old_values STRING, "
        "new_values STRING, created_at TIMESTAMP",
        (1, 1, "update", "order", 5, '{"a": 1, "b": "x", "c": null}', '{"a": 2, "b": "x", "d": true}', NOW),
        (2, 1, "create", "order", 6, None, '{"a": 1}', NOW),
    )
    assert rows_of(audit_changes(log), "log_id", "field", "old_value", "new_value") == [
        (1, "a", "1", "2"), (1, "d", None, "true"), (2, "a", None, "1"),
    ]
