"""Published versions, row numbers, and pages near and far from the start."""

from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.conftest import NOW, rows_of
from tiffin.operators import orders, paging, sequences
from tiffin.operators.sequences import number_rows, previous_in_order
from tiffin.sources import store
from tiffin.sources.model import load_model, load_model_csv, register_views
from tiffin.sources.schemas import MODEL, fields
from tiffin.sources.sizes import has_at_most, small


def test_readers_see_whole_versions(spark, tmp_path, make):
    folder = str(tmp_path / "store")
    one, two = make("k INT", (1,)), make("k INT", (1,), (2,))
    assert store.current(spark, folder, "a") is None and store.latest_version(spark, folder) is None
    store.publish({"a": one, "b": one}, folder, 1)
    store.publish({"a": two}, folder, 2)
    assert (store.current(spark, folder, "a").count(), store.current(spark, folder, "b").count()) == (2, 1)
    assert store.current(spark, folder, "a", version=1).count() == 1
    store.publish({"a": one}, folder, 2)  # a replay replaces its version
    assert store.current(spark, folder, "a").count() == 1
    with pytest.raises(ValueError):
        store.publish({"a": two}, folder, 1)
    # files of a version that was never completed are not seen
    two.write.parquet(f"{folder}/v=9/a")
    assert store.current(spark, folder, "a").count() == 1


def test_model_round_trip(spark, tmp_path, seed):
    folder = str(tmp_path / "model")
    store.publish(seed, folder, 1)
    model = load_model(spark, folder)
    assert {n: df.count() for n, df in model.items()} == {n: df.count() for n, df in seed.items()}
    assert all(model[n].schema == fields(MODEL[n]) for n in MODEL)
    register_views(model)
    assert spark.sql("SELECT count(*) FROM orders JOIN order_items USING (order_id)").first()[0] == 6
    for name, df in seed.items():
        df.selectExpr(*[f"CAST({c} AS INT) AS {c}" if t == "boolean" else c for c, t in df.dtypes]).write.csv(
            f"{tmp_path}/csv/{name}", header=True
        )
    from_csv = load_model_csv(spark, f"{tmp_path}/csv")
    assert rows_of(from_csv["menu_items"], "item_id", "price", "is_active") == rows_of(
        seed["menu_items"], "item_id", "price", "is_active"
    )


def test_appended_lines_and_change_log(spark, tmp_path, seed, make):
    path = str(tmp_path / "lines")
    for batch in (1, 2, 2):
        store.append_lines(seed["order_items"], path, batch)
    back = spark.read.parquet(path)
    assert back.count() == 12 and "order_date" in back.columns
    log = make("order_id BIGINT, status STRING, at TIMESTAMP, seq BIGINT", (1, "a", NOW, 1), (1, "b", NOW, 2), (2, "c", NOW, 1))
    store.compact(log, "order_id", ["at", "seq"], str(tmp_path / "orders"), "orders", 1)
    assert rows_of(store.current(spark, str(tmp_path / "orders"), "orders"), "order_id", "status") == [(1, "b"), (2, "c")]


def test_numbers_are_consecutive_in_order_with_a_hot_value(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS hot").repartition(6)
    got = number_rows(df, ["hot", "id"], "n", 100)
    want = {row: n for n, row in enumerate(sorted((7 if i % 3 == 0 else i, i) for i in range(2000)), 101)}
    assert {(r.hot, r.id): r.n for r in got.collect()} == want


@pytest.mark.parametrize("group", [10_000, 3])
def test_previous_row_by_day_and_by_slice(spark, monkeypatch, group):
    monkeypatch.setattr(sequences, "MAX_GROUP_ROWS", group)
    got = previous_in_order(many_orders(spark), "user_id", ["created_at", "order_id"], "order_id", "before").collect()
    want, last = {}, {}
    for r in sorted(got, key=lambda r: (r.created_at, r.order_id)):
        want[r.order_id] = last.get(r.user_id)
        last[r.user_id] = r.order_id
    assert len(got) == 1000 and {r.order_id: r.before for r in got} == want


def test_small_marks_only_what_fits(spark):
    assert has_at_most(spark.range(10), 10) and not has_at_most(spark.range(11), 10)
    hinted = spark.range(10).join(small(spark.range(10), 10), "id")
    plain = spark.range(10).join(small(spark.range(11), 10), "id")
    hint = "ResolvedHint (strategy=broadcast)"
    assert hint in hinted._jdf.queryExecution().analyzed().toString()
    assert hint not in plain._jdf.queryExecution().analyzed().toString()


def many_orders(spark):
    """1,000 orders on 30 days, 400 of them of one customer."""
    return spark.range(1000).selectExpr(
        "id AS order_id",
        "CASE WHEN id % 5 < 2 THEN 1 ELSE id % 50 + 2 END AS user_id",
        "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id * 7 % 30 AS INT)) AS created_at",
    )


def newest(rows):
    return sorted(rows, key=lambda r: (r.created_at, r.order_id), reverse=True)


@pytest.mark.parametrize("top", [10_000, 100, 10])
def test_pages_far_from_the_start(spark, monkeypatch, top):
    monkeypatch.setattr(paging, "TOP_ROWS", top)
    all_rows = newest(many_orders(spark).collect())
    for number in (1, 4, 17, 50, 51, 60):
        got = newest(paging.page(many_orders(spark), number, 20).collect())
        assert got == all_rows[(number - 1) * 20 : number * 20]


@pytest.mark.parametrize("bound, group", [(1_000, 100), (5, 100), (5, 2)])
def test_pages_per_key_far_from_the_start(spark, monkeypatch, bound, group):
    monkeypatch.setattr(paging, "GROUP_LIMIT_ROWS", bound)
    monkeypatch.setattr(sequences, "MAX_GROUP_ROWS", group)
    rows = many_orders(spark).collect()
    for number in (1, 3, 40):
        got = paging.pages_per_key(many_orders(spark), "user_id", number, 10).collect()
        want = set()
        for user in {r.user_id for r in rows}:
            mine = newest([r for r in rows if r.user_id == user])
            want |= {(r.order_id, n) for n, r in enumerate(mine, 1) if (number - 1) * 10 < n <= number * 10}
        assert {(r.order_id, r.row_number) for r in got} == want


def undated(spark):
    """Many orders, some without date, some without user."""
    return many_orders(spark).withColumns(
        {
            "created_at": F.when(F.col("order_id") % 9 != 0, F.col("created_at")),
            "user_id": F.when(F.col("order_id") % 4 != 0, F.col("user_id")),
        }
    )


def undated_last(rows):
    return sorted(rows, key=lambda r: (r.created_at is not None, r.created_at or 0, r.order_id), reverse=True)


@pytest.mark.parametrize("bound", [10_000, 5])
def test_orders_without_date_or_user_are_on_the_pages(spark, monkeypatch, bound):
    monkeypatch.setattr(paging, "TOP_ROWS", bound)
    monkeypatch.setattr(paging, "GROUP_LIMIT_ROWS", bound)
    rows = undated(spark).collect()
    ordered = [r.order_id for r in undated_last(rows)]
    for number in range(1, len(rows) // 150 + 2):
        got = paging.page(undated(spark), number, 150).collect()
        assert [r.order_id for r in undated_last(got)] == ordered[(number - 1) * 150 : number * 150]
    for group in (10_000, 2):
        monkeypatch.setattr(sequences, "MAX_GROUP_ROWS", group)
        got = {(r.order_id, r.row_number) for r in paging.pages_per_key(undated(spark), "user_id", 2, 20).collect()}
        want = set()
        for user in {r.user_id for r in rows}:
            mine = undated_last([r for r in rows if r.user_id == user])
            want |= {(r.order_id, n) for n, r in enumerate(mine, 1) if 20 < n <= 40}
        assert got == want


def test_page_after_continues_the_page_before(spark):
    first = paging.page(many_orders(spark), 1).collect()
    last = newest(first)[-1]
    after = paging.page_after(many_orders(spark), last.created_at, last.order_id)
    assert newest(after.collect()) == newest(paging.page(many_orders(spark), 2).collect())


def test_page_and_size_are_clamped():
    assert paging.bounds(-3, 0) == (0, 1)
    assert paging.bounds(2, 10**9) == (10**9, 10**9)


def test_page_totals(spark, seed):
    found = orders.page_with_total(seed["orders"], seed["order_items"], 3, 2, 2)
    assert [(r.order_id, r.unit_count) for r in found.rows.collect()] == [(1, 3)]
    past = orders.page_with_total(seed["orders"], seed["order_items"], 3, 9, 2)
    for total in (found.total, past.total):
        assert [tuple(r) for r in total.collect()] == [(3, 3)]
    assert past.rows.collect() == []
    every = orders.order_pages(seed["orders"], seed["order_items"], 1, 2)
    assert rows_of(every, "order_id", "row_number", "total_count") == [(2, 2, 3), (3, 1, 3)]
    assert orders.orders_per_user(seed["orders"]).first().order_count == 3


def test_completed_on_day(seed):
    assert rows_of(orders.completed_on(seed["orders"], (NOW - timedelta(days=7)).date()), "order_id") == [(1,)]
    assert seed["orders"].first().total_amount == D("19.98") and isinstance(NOW, datetime)
