"""Pricing and change application against row-by-row expectations."""

from datetime import datetime, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from tests.conftest import NOW, rows_of
from tiffin.operators import changes, pricing, quality
from tiffin.session import kept
from tiffin.sources.schemas import MESSAGES

GONE = 'Item "%s" is no longer available. Please remove it from your cart.'


def requests(spark, *rows):
    full = [
        (n, 3, items, "cash", "", "asap", None, NOW + timedelta(seconds=n)) for n, items in rows
    ]
    return spark.createDataFrame(full, MESSAGES["order_request"])


def test_pricing_rejects_whole_requests_with_the_first_reason(spark, seed):
    menu = seed["menu_items"].withColumn("is_active", F.col("item_id") != 4)
    menu = menu.withColumn("is_available", F.col("item_id") != 5)
    batch = requests(
        spark,
        (1, [(1, 2), (1, 1), (9, 1)]),  # the same item twice gives two lines
        (2, [(1, 1), (4, 1), (77, 1)]),  # first bad line: inactive item 4
        (3, [(77, 1), (4, 1)]),  # first bad line: unknown item 77
        (4, [(5, 1)]),  # unavailable is not inactive
    )
    priced = pricing.price_orders(batch, menu)
    assert rows_of(priced.orders, "request_id", "total_amount") == [(1, D("29.96")), (4, D("12.99"))]
    assert rows_of(priced.lines, "request_id", "pos", "item_id", "subtotal") == [
        (1, 0, 1, D("17.98")), (1, 1, 1, D("8.99")), (1, 2, 9, D("2.99")), (4, 0, 5, D("12.99")),
    ]
    assert rows_of(priced.rejects, "request_id", "reason") == [(2, GONE % "Margherita Pizza"), (3, GONE % 77)]
    first = priced.orders.orderBy("request_id").first()
    assert first.order_number == "ORD1710072001000-1" and first.special_instructions is None


def test_unknown_activity_does_not_reject(spark, seed):
    menu = seed["menu_items"].withColumn("is_active", F.lit(None).cast("boolean"))
    assert pricing.price_orders(requests(spark, (1, [(1, 1)])), menu).orders.count() == 1


def test_a_total_too_large_for_the_order_table_is_rejected(spark, seed):
    batch = requests(spark, (1, [(1, 2_000_000_000)]), (2, [(3, 900_000_000), (3, 900_000_000)]), (3, [(1, 1)]))
    priced = pricing.price_orders(batch, seed["menu_items"])
    assert rows_of(priced.orders, "request_id") == [(3,)] and priced.lines.count() == 1
    assert rows_of(priced.rejects, "request_id", "reason") == [(1, "Failed to create order"), (2, "Failed to create order")]


def test_order_ids_follow_arrival(spark, seed):
    batch = requests(spark, *[(n, [(1, 1), (2, 1)]) for n in range(40, 0, -1)])
    done = pricing.with_order_ids(pricing.price_orders(batch, seed["menu_items"]), 3, 6)
    assert rows_of(done.orders, "order_id") == [(n,) for n in sorted(range(4, 44), key=str)]
    pairs = {(r.request_id, r.order_id) for r in done.orders.collect()}
    assert pairs == {(n, n + 3) for n in range(1, 41)}
    assert sorted(r.order_item_id for r in done.lines.collect()) == list(range(7, 87))


def test_kept_lines_are_priced_once(spark, seed):
    batch = requests(spark, (1, [(1, 2), (1, 1)]), (2, [(77, 1)]), (3, []))
    priced = pricing.price_orders(batch, seed["menu_items"], kept)
    plain = pricing.price_orders(batch, seed["menu_items"])
    for now, before in zip(priced, plain):
        assert rows_of(now) == rows_of(before)
        plan = now._jdf.queryExecution().toString()
        assert "Generate" not in plan and "item_name" not in plan  # what was kept is read, no line is looked up again


def item_changes(make, *rows):
    return make(
        "item_id BIGINT, category_id INT, item_name STRING, description STRING, price DECIMAL(10,2), "
        "is_available BOOLEAN, at TIMESTAMP, seq BIGINT",
        *rows,
    )


def test_item_update_keeps_the_image_and_reports_unknown_items(seed, make):
    menu = seed["menu_items"].withColumn("image_url", F.lit("old.png"))
    later = NOW + timedelta(days=1)
    changed = changes.update_items(
        menu,
        item_changes(
            make,
            (1, 2, "First", "x", D("1.00"), True, later, 1),
            (1, 0, "Second", "", D("2.00"), None, later, 2),
            (99, 1, "Nobody", "", D("1.00"), True, later, 3),
        ),
    )
    row = changed.state.filter("item_id = 1").first()
    assert (row.category_id, row.item_name, row.description, row.price) == (None, "Second", None, D("2.00"))
    assert (row.is_available, row.image_url, row.updated_at) == (False, "old.png", later)
    assert rows_of(changed.rejected, "item_id", "reason") == [(99, "Menu item not found")]


def test_soft_delete_of_an_inactive_item_is_no_error(seed, make):
    gone = make("item_id BIGINT, at TIMESTAMP", (1, NOW), (1, NOW), (99, NOW))
    once = changes.soft_delete_items(seed["menu_items"], gone)
    again = changes.soft_delete_items(once.state, gone)
    assert rows_of(again.state.filter("NOT is_active"), "item_id") == [(1,)]
    assert rows_of(again.rejected, "item_id") == [(99,)]


def test_category_status_cascades_to_every_item(seed, make):
    menu = seed["menu_items"].withColumns(
        {"is_active": F.col("item_id") != 1, "is_available": F.col("item_id") != 2}
    )
    sent = make(
        "category_id INT, category_name STRING, is_active BOOLEAN, at TIMESTAMP, seq BIGINT",
        (1, None, False, NOW, 1),
        (1, " Grill ", True, NOW, 2),  # reactivation revives item 1 as well
        (2, "Pies", None, NOW, 3),  # a rename alone does not cascade
        (3, "  ", None, NOW, 4),
        (8, "New", True, NOW, 5),
    )
    result = changes.apply_category_changes(seed["categories"], menu, sent)
    names = {r.category_id: (r.category_name, r.is_active) for r in result.categories.collect()}
    assert names[1] == ("Grill", True) and names[2] == ("Pies", True) and names[3] == ("Salads", True)
    items = {r.item_id: (r.is_active, r.is_available) for r in result.menu_items.collect()}
    assert all(items[n] == (True, True) for n in (1, 2, 3)) and items[4] == (True, True)
    assert rows_of(result.rejected, "seq", "reason") == [
        (4, "No valid fields to update"), (5, "Category not found"),
    ]


def test_order_updates_apply_only_valid_fields(seed, make):
    sent = make(
        "order_id BIGINT, status STRING, payment_status STRING, at TIMESTAMP, seq BIGINT",
        (1, "pending", "broken", NOW, 1),  # any known state may follow any other
        (2, "lost", "paid", NOW, 2),
        (3, "lost", None, NOW, 3),
        (9, "ready", None, NOW, 4),
    )
    result = changes.apply_order_updates(seed["orders"], sent)
    assert rows_of(result.state, "order_id", "status", "payment_status") == [
        (1, "pending", "paid"), (2, "ready", "paid"), (3, "preparing", "paid"),
    ]
    assert rows_of(result.rejected, "seq") == [(3,), (4,)]


def test_inserts_are_accepted_one_by_one(spark, seed, make):
    new = make(
        "request_id BIGINT, username STRING, email STRING, full_name STRING, phone STRING, role STRING",
        (1, "Customer1 ", "a@x.org", "taken name", "", "customer"),
        (2, "bob", "b@x.org", "Bob", "", "admin"),
        (3, "BOB", "c@x.org", "second Bob", "", "customer"),
        (4, "carol", "c@x.org", "free, as request 3 was refused", "", "other"),
        (5, "José", "d@x.org", "José", "", "customer"),
        (6, "jose", "e@x.org", "same name without accent", "", "customer"),
    )
    ready = changes.new_users(new, F.lit(NOW))
    result = changes.insert_rows(seed["users"], ready, "user_id", ["username", "email"], ["request_id"])
    added = result.state.filter("user_id > 3")
    assert rows_of(added, "user_id", "username", "role", "phone") == [
        (4, "bob", "admin", None), (5, "carol", "customer", None), (6, "José", "customer", None),
    ]
    assert rows_of(result.rejected, "request_id") == [(1,), (3,), (6,)]


def test_new_rows_get_their_defaults(seed, make):
    item = make(
        "request_id BIGINT, item_name STRING, category_id INT, description STRING, price DECIMAL(10,2), "
        "image_url STRING, is_available BOOLEAN",
        (1, "Tea", 0, "", D("1.50"), "", None),
    )
    result = changes.insert_rows(
        seed["menu_items"], changes.new_items(item, F.lit(NOW)), "item_id", [], ["request_id"]
    )
    row = result.state.filter("item_id = 11").first()
    assert (row.category_id, row.description, row.image_url, row.is_available, row.is_active) == (
        None, None, None, False, True,
    )
    category = make("request_id BIGINT, category_name STRING, is_active BOOLEAN", (1, "Soups", None))
    added = changes.insert_rows(
        seed["categories"], changes.new_categories(category, F.lit(NOW)), "category_id", ["category_name"], ["request_id"]
    )
    assert rows_of(added.state.filter("category_id = 6"), "category_name", "is_active") == [("Soups", True)]


def test_deletes_follow_the_foreign_keys(seed, make):
    audit = make(
        "log_id BIGINT, user_id BIGINT, action STRING, entity_type STRING, entity_id BIGINT, old_values STRING, "
        "new_values STRING, ip_address STRING, created_at TIMESTAMP",
        (1, 1, "login", None, None, None, None, None, NOW),
    )
    model = dict(seed, audit_logs=audit)
    deletes = make(
        "table STRING, id BIGINT", ("orders", 1), ("users", 1), ("categories", 4), ("menu_items", 1), ("menu_items", 2)
    )
    result = changes.propagate_deletes(model, deletes)
    left = {name: df.count() for name, df in result.model.items()}
    assert left == {"users": 2, "categories": 4, "menu_items": 9, "orders": 2, "order_items": 4, "audit_logs": 1}
    assert rows_of(result.model["menu_items"].filter("category_id IS NULL"), "item_id") == [(8,), (9,)]
    assert result.model["audit_logs"].first().user_id is None
    assert rows_of(result.rejected, "id") == [(2,)]  # item 1 was only on order 1, which is gone
    all_orders = changes.propagate_deletes(model, make("table STRING, id BIGINT", ("users", 3)))
    assert all_orders.model["orders"].count() == all_orders.model["order_items"].count() == 0


def test_admin_cap_takes_the_first_to_arrive(spark, seed, make):
    signups = make(
        "request_id BIGINT, ts TIMESTAMP, role STRING",
        (1, NOW + timedelta(hours=1), "admin"),
        (2, NOW, "admin"),
        (3, NOW, None),
    )
    result = quality.cap_admins(seed["users"], signups)
    assert rows_of(result.valid, "request_id") == [(2,), (3,)]
    assert rows_of(result.rejected, "request_id") == [(1,)]


def test_order_requests_report_the_first_problem(spark):
    future, past = "2024-03-11T10:00:00.500", "2024-03-01 10:00:00"
    rows = [
        (1, [(1, 1)], "cash", "scheduled", None, "Scheduled time is required for scheduled orders."),
        (2, None, "cash", "scheduled", past, "Invalid or past scheduled time."),
        (3, [], None, "asap", None, "Order must contain at least one item"),
        (4, [(None, 0)], "", "asap", None, "Payment method is required"),
        (5, [(1, 1), (None, 1), (1, 0)], "cash", "asap", None, "Invalid item data (item ID or quantity missing/invalid)."),
        (6, [(1, 0), (None, 1)], "cash", "odd", "ignored", "Item quantity must be at least 1"),
        (7, [(1, 1)], "cash", "scheduled", future, None),
    ]
    batch = spark.createDataFrame(
        [(n, 3, items, pay, None, kind, due, NOW) for n, items, pay, kind, due, _ in rows], MESSAGES["order_request"]
    )
    split = quality.split(quality.check_order_requests(batch))
    found = {r.request_id: r.first_error for r in split.rejected.collect()}
    assert found == {n: text for n, *_, text in rows if text}
    good = split.valid.first()
    assert good.scheduled_at == datetime(2024, 3, 11, 10) and good.order_type == "scheduled"


def test_status_before_the_first_of_a_day_comes_from_the_day_before(make):
    history = make(
        "order_id BIGINT, at TIMESTAMP, seq BIGINT, status STRING",
        (1, NOW, 1, "pending"),
        (1, NOW, 2, "completed"),
        (1, NOW + timedelta(days=2), 3, "ready"),
        (1, NOW + timedelta(days=2), 4, "confirmed"),
        (2, NOW, 1, "eaten"),
        (2, NOW, 2, "pending"),
    )
    found = quality.status_anomalies(history)
    assert rows_of(found, "order_id", "seq", "previous", "anomaly") == [
        (1, 3, "completed", "left an end state"), (1, 4, "ready", "step back"), (2, 1, None, "unknown status"),
    ]
