"""Hand-computed results over the seed tables."""

from datetime import date
from decimal import Decimal as D

from tests.conftest import NOW, rows_of
from tiffin.operators import catalog, documents, orders, quality, sales


def test_menu_is_sorted_by_category_then_name(seed):
    names = [r.item_name for r in catalog.menu_catalog(seed["menu_items"], seed["categories"]).collect()]
    assert names == [
        "Fresh Juice", "Iced Coffee", "Bacon Burger", "Cheese Burger", "Classic Burger", "Chocolate Cake",
        "Margherita Pizza", "Pepperoni Pizza", "Caesar Salad", "Greek Salad",
    ]


def test_top_selling_breaks_ties_by_item(seed):
    top = sales.top_selling(seed["order_items"], seed["menu_items"], 3).collect()
    assert [(r.item_id, r.total_quantity_sold, r.total_revenue, r.times_ordered) for r in top] == [
        (1, 2, D("17.98"), 1), (2, 1, D("9.99"), 1), (5, 1, D("12.99"), 1),
    ]


def test_items_never_ordered_keep_null_and_come_last(seed):
    rows = sales.item_order_counts(seed["order_items"], seed["menu_items"], seed["categories"]).collect()
    assert {r.item_id for r in rows if r.total_quantity_ordered is None} == {3, 4, 6, 8}
    assert [r.total_quantity_ordered for r in rows[-4:]] == [None] * 4


def test_three_items_are_marked_in_the_ranking(seed):
    rows = sales.preparation_ranking(seed["order_items"], seed["menu_items"], seed["categories"]).collect()
    assert [r.item_name for r in rows if r.is_top] == ["Classic Burger", "Cheese Burger", "Chocolate Cake"]
    assert [r.is_top for r in rows][:3] == [True] * 3


def test_daily_sales_of_a_day_and_of_an_empty_day(seed):
    day = sales.daily_sales(seed["orders"], date(2024, 3, 3)).collect()
    assert [tuple(r) for r in day] == [(date(2024, 3, 3), 1, 1, D("19.98"), D("19.980000"))]
    empty = sales.daily_sales(seed["orders"], date(2020, 1, 1)).collect()
    assert [tuple(r) for r in empty] == [(None, 0, 0, None, None)]


def test_overview(seed):
    menu = catalog.menu_rows(seed["menu_items"], seed["categories"])
    assert tuple(sales.overview_kpis(seed["orders"], menu).first()) == (3, D("59.94"), 0, 10)


def test_overview_counts_bad_totals_as_zero(spark, seed):
    menu = catalog.menu_rows(seed["menu_items"], seed["categories"])
    bad = spark.createDataFrame([("12.50",), ("n/a",), (None,)], "total_amount STRING").selectExpr(
        "total_amount", "'pending' AS status"
    )
    assert tuple(sales.overview_kpis(bad, menu).first()) == (3, D("12.50"), 3, 10)


def test_every_seed_total_disagrees_with_its_lines(seed):
    found = quality.total_reconciliation(seed["orders"], seed["order_items"])
    assert rows_of(found, "order_id", "line_total") == [(1, D("20.97")), (2, D("14.98")), (3, D("21.98"))]
    assert quality.line_reconciliation(seed["order_items"]).count() == 0


def test_constraints_find_only_the_role_outside_the_domain(seed):
    broken = quality.constraint_report(seed).filter("violations > 0")
    assert rows_of(broken) == [("users", "enum role", 1)]
    assert rows_of(quality.constraint_quarantine("users", seed["users"]).rejected, "username") == [("staff1",)]


def test_customer_documents(seed):
    docs = documents.order_documents(seed["orders"], seed["order_items"], seed["menu_items"], user_id=3)
    by_id = {r.order_id: r for r in docs.collect()}
    assert [(i.item_name, i.quantity) for i in by_id[1]["items"]] == [("Classic Burger", 2), ("Fresh Juice", 1)]
    assert by_id[1].created_at == NOW.replace(day=3)
    others = documents.order_documents(
        seed["orders"], seed["order_items"], seed["menu_items"], user_id=1, order_ids=[1, 2]
    )
    assert others.count() == 0


def test_order_summary_of_unknown_order_is_empty(seed):
    summary = orders.order_summary(seed["orders"], seed["users"], seed["order_items"], [2, 99])
    assert rows_of(summary, "order_id", "username", "line_count") == [(2, "customer1", 2)]


def test_recent_orders_newest_first(seed):
    recent = orders.recent_orders(seed["orders"], seed["users"], seed["order_items"])
    assert [r.order_id for r in recent.collect()] == [3, 2, 1]
