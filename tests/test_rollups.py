"""Kept totals against the same figures computed anew."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tiffin.operators import rollups, sales
from tiffin.plans import queries
from tiffin.sources import base_tables, store

ORDERS = "order_id BIGINT, user_id BIGINT, status STRING, created_at TIMESTAMP_NTZ, total_amount DECIMAL(12,2)"
LINES = "order_id BIGINT, item_id BIGINT, quantity INT, subtotal DECIMAL(12,2)"
MENU = "item_id BIGINT, item_name STRING"


def some_order(rng, n):
    day = rng.choice([None, *[datetime(2024, 3, d, 10) for d in (1, 2, 3)]])
    amount = rng.choice([None, Decimal(rng.randrange(5000)) / 100])
    return (n, rng.choice([None, 1, 2, 3]), rng.choice(["completed", "completed", "pending", None]), day, amount)


def some_lines(rng, n):
    return [
        (n, rng.randrange(6), rng.choice([None, 1, 2]), rng.choice([None, Decimal(rng.randrange(900)) / 100]))
        for _ in range(rng.randrange(4))
    ]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_totals_follow_changes_and_deletes(spark, make, tmp_path):
    rng, folder = random.Random(5), str(tmp_path / "t")
    orders = {n: some_order(rng, n) for n in range(40)}
    lines = {n: some_lines(rng, n) for n in range(40)}

    def frames(ids):
        found = [n for n in ids if n in orders]
        return make(ORDERS, *[orders[n] for n in found]), make(LINES, *[x for n in found for x in lines[n]])

    def same():
        all_orders, all_lines = frames(sorted(orders))
        kept = rollups.daily_sales(store.current(spark, folder, "sales"))
        anew = sales.daily_sales(all_orders)
        assert collected(kept) == collected(anew) and kept.columns == anew.columns
        menu = make(MENU, *[(n, f"item {n}") for n in range(5)])
        kept = rollups.top_selling(store.current(spark, folder, "items"), menu, 4)
        assert collected(kept) == collected(sales.top_selling(all_lines, menu, 4))

    none = frames([])
    every = frames(range(40))
    rollups.start({"sales": rollups.sales_change(none[0], every[0]), "items": rollups.items_change(none[1], every[1])}, folder, 4)
    same()
    sent = []
    for batch in range(3):
        ids = rng.sample(range(45), 15)  # changed, deleted, new
        before = frames(ids)
        for n in ids:
            if rng.random() < 0.4:
                orders.pop(n, None)
            else:
                orders[n], lines[n] = some_order(rng, n), some_lines(rng, n)
        after = frames(ids)
        change = {"sales": rollups.sales_change(before[0], after[0]), "items": rollups.items_change(before[1], after[1])}
        assert rollups.add(spark, change, folder, batch, 4)
        assert rollups.add(spark, change, folder, batch, 4)  # replaces itself
        sent.append(change)
        same()
    assert not rollups.add(spark, sent[0], folder, 0, 4)  # counted already
    same()


def test_a_customer_leaves_a_day_with_the_last_order(spark, make, tmp_path):
    folder, day = str(tmp_path / "t"), datetime(2024, 3, 1)
    rows = [(n, n // 2, "completed", day, Decimal("1.10")) for n in range(4)]
    none, lines = make(ORDERS), make(LINES)
    empty = rollups.items_change(lines, lines)
    rollups.start({"sales": rollups.sales_change(none, make(ORDERS, *rows)), "items": empty}, folder, 4)
    counts = []
    for batch, row in enumerate(rows[:3]):
        cancelled = (*row[:2], "cancelled", *row[3:])
        change = rollups.sales_change(make(ORDERS, row), make(ORDERS, cancelled))
        rollups.add(spark, {"sales": change}, folder, batch, 4)
        shown = rollups.daily_sales(store.current(spark, folder, "sales")).first()
        counts.append((shown.total_orders, shown.unique_customers, shown.total_revenue))
    assert counts == [(3, 2, Decimal("3.30")), (2, 1, Decimal("2.20")), (1, 1, Decimal("1.10"))]


def test_the_same_rows_change_nothing_and_write_nothing(spark, make, tmp_path):
    folder, day = str(tmp_path / "t"), datetime(2024, 3, 1)
    rows = make(ORDERS, (1, 1, "completed", day, Decimal("2.00")), (2, None, "completed", None, None))
    rollups.start({"sales": rollups.sales_change(rows.limit(0), rows)}, folder, 4)
    rollups.add(spark, {"sales": rollups.sales_change(rows, rows)}, folder, 0, 4)
    assert store.latest_version(spark, folder) == 0
    dearer = rows.withColumn("total_amount", F.lit(Decimal("3.00")).cast("decimal(12,2)"))
    rollups.add(spark, {"sales": rollups.sales_change(rows, dearer)}, folder, 1, 4)
    shown = {r.sale_date: (r.total_revenue, r.unique_customers) for r in rollups.daily_sales(store.current(spark, folder, "sales")).collect()}
    assert shown == {day.date(): (Decimal("3.00"), 1), None: (Decimal("3.00"), 0)}


def test_totals_have_to_be_started(spark, make, tmp_path):
    rows = make(ORDERS)
    with pytest.raises(ValueError, match="no totals"):
        rollups.add(spark, {"sales": rollups.sales_change(rows, rows)}, str(tmp_path / "t"), 0)


def test_a_batch_sent_twice_is_made_once(spark, tmp_path, monkeypatch):
    """The kept totals read each batch's change from files; the newest changes decide and cancelled orders are gone."""
    day = datetime(2024, 1, 5)
    tables = {
        "customer": [(n, f"Customer#{n}", 1, 1.0, "A") for n in (1, 2)],
        "part": [(1, "dish", "Brand#11", "type", 2, 3.0)],
        "orders": [(n, 1 + n % 2, "F", float(n), day, "1-URGENT") for n in range(1, 9)],
        "lineitem": [(n, 1, 1, 1, 2.0, 10.0, 0.0, 0.0, "N", "O", day) for n in range(1, 9)],
        # Orders 3 * user_id + k: the first is cancelled in spring, the second and third in the last quarter.
        "events": [
            (1, datetime(2024, 2, 1), 0, "view", 1.0, '{"k": 3}'),
            (2, datetime(2024, 5, 1), 0, "view", 1.0, '{"k": 1}'),
            (3, datetime(2024, 11, 1), -3, "view", 1.0, '{"k": 11}'),
            (4, None, 0, "view", 1.0, '{"k": 6}'),
        ],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, base_tables.BASE[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    own, plans = rollups.add, []

    def add(spark, changes, *rest):
        plans.extend(rows._jdf.queryExecution().optimizedPlan().toString() for rows in changes.values())
        return own(spark, changes, *rest)

    monkeypatch.setattr(rollups, "add", add)
    model = base_tables.model_from_base(spark, str(tmp_path))
    shown = queries.daily_sales_kept(model, spark, str(tmp_path)).collect()
    # Cancelled: 1 and 6 by k % 5 == 1, 2 by k % 5 == 1 of 11.
    assert [(r.total_orders, r.unique_customers, r.total_revenue) for r in shown] == [(5, 2, Decimal("27.00"))]
    assert len(plans) == 9 and not any("Join" in plan or "Aggregate" in plan for plan in plans)
