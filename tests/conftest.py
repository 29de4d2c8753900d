from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tiffin.session import local_session
from tiffin.sources.schemas import MODEL, fields

NOW = datetime(2024, 3, 10, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, "tiffin-tests", **{"spark.checkpoint.dir": folder})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build a small table from a DDL schema and rows."""

    def build(schema: str, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


def rows_of(df, *columns):
    """Rows as sorted tuples; NULL sorts first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, str(v)) for v in t])


# The seed data set.
CATEGORIES = ["Burgers", "Pizza", "Salads", "Beverages", "Desserts"]
ITEMS = [
    (1, "Classic Burger", "8.99"),
    (1, "Cheese Burger", "9.99"),
    (1, "Bacon Burger", "10.99"),
    (2, "Margherita Pizza", "11.99"),
    (2, "Pepperoni Pizza", "12.99"),
    (3, "Caesar Salad", "7.99"),
    (3, "Greek Salad", "8.99"),
    (4, "Iced Coffee", "3.99"),
    (4, "Fresh Juice", "2.99"),
    (5, "Chocolate Cake", "4.99"),
]
USERS = [("admin", "admin"), ("staff1", "staff"), ("customer1", "customer")]
ORDERS = [
    ("ORD1700000001", "19.98", "credit_card", "paid", "completed", "No onions please", 7),
    ("ORD1700000002", "15.99", "cash", "pending", "ready", None, 3),
    ("ORD1700000003", "23.97", "credit_card", "paid", "preparing", "Extra sauce on the side", 0),
]
LINES = [
    (1, 1, 2, "8.99", "17.98"),
    (1, 9, 1, "2.99", "2.99"),
    (2, 2, 1, "9.99", "9.99"),
    (2, 10, 1, "4.99", "4.99"),
    (3, 5, 1, "12.99", "12.99"),
    (3, 7, 1, "8.99", "8.99"),
]


@pytest.fixture(scope="session")
def seed(spark):
    """The seed tables: 5 categories, 10 items, 3 users, 3 orders, 6 lines."""

    def table(name, rows):
        return spark.createDataFrame(rows, fields(MODEL[name]))

    d = Decimal
    return {
        "users": table(
            "users",
            [
                (n, name, f"{name}@example.org", name.title(), "5555555555", role, True, NOW, NOW, None)
                for n, (name, role) in enumerate(USERS, 1)
            ],
        ),
        "categories": table("categories", [(n, c, None, True, NOW, NOW) for n, c in enumerate(CATEGORIES, 1)]),
        "menu_items": table(
            "menu_items",
            [
                (n, category, name, None, d(price), None, True, True, NOW, NOW)
                for n, (category, name, price) in enumerate(ITEMS, 1)
            ],
        ),
        "orders": table(
            "orders",
            [
                (n, 3, number, d(total), method, paid, status, "asap", None, note, NOW - timedelta(days=age), NOW)
                for n, (number, total, method, paid, status, note, age) in enumerate(ORDERS, 1)
            ],
        ),
        "order_items": table(
            "order_items",
            [
                (n, order, item, quantity, d(price), d(subtotal), None, NOW)
                for n, (order, item, quantity, price, subtotal) in enumerate(LINES, 1)
            ],
        ),
        "audit_logs": table("audit_logs", []),
    }
