"""Batches of orders: what they publish, and what they leave on disk."""

import glob
from datetime import timedelta
from decimal import Decimal as D

import pytest

from tests.conftest import NOW, rows_of
from tiffin.operators import placement, pricing
from tiffin.session import LEAN_SETTINGS, Scratch, kept, shared_dir
from tiffin.sources import store
from tiffin.sources.schemas import MESSAGES

NO_ITEMS = "Order must contain at least one item"
GONE = 'Item "77" is no longer available. Please remove it from your cart.'


def requests(spark, *rows, paid="cash"):
    full = [(n, 3, items, paid, "", "asap", None, NOW + timedelta(seconds=n or 0)) for n, items in rows]
    return spark.createDataFrame(full, MESSAGES["order_request"])


def left_over(spark):
    """Folders that keeping and checkpoints have left in the shared folder."""
    folder = shared_dir(spark).removeprefix("file:")
    return set(glob.glob(f"{folder}/kept/*") + glob.glob(f"{folder}/*/rdd-*"))


def settings(spark):
    return {key: spark.conf.get(key, None) for key in LEAN_SETTINGS}


@pytest.fixture
def batch(spark):
    good = [(n, [(1, 1), (2, n)]) for n in range(9, 0, -1)]
    return requests(spark, *good, (10, [(77, 1)]), (11, [])).unionByName(requests(spark, (12, [(1, 1)]), paid=None))


def test_a_batch_sent_twice_leaves_only_its_tables(spark, seed, batch, tmp_path):
    files, before = left_over(spark), settings(spark)
    for _ in range(2):
        tables = placement.place_orders(batch, seed["menu_items"], seed["users"], str(tmp_path / "o"), 1, 100, 500)
    assert left_over(spark) == files and settings(spark) == before
    assert rows_of(tables["orders"], "order_id", "request_id", "total_amount") == [
        (100 + n, n, D("8.99") + n * D("9.99")) for n in range(1, 10)
    ]
    assert rows_of(tables["lines"], "order_item_id", "order_id", "pos", "quantity") == [
        (500 + 2 * n - 1 + pos, 100 + n, pos, (1, n)[pos]) for n in range(1, 10) for pos in (0, 1)
    ]
    assert rows_of(tables["rejects"]) == [(10, 3, GONE), (11, 3, NO_ITEMS), (12, 3, "Payment method is required")]
    assert rows_of(tables["events"], "orderId", "username") == [(100 + n, "customer1") for n in range(1, 10)]


def test_what_no_table_reads_is_gone_before_it_is_published(spark, seed, batch, tmp_path, monkeypatch):
    files, seen, publish = left_over(spark), [], store.publish

    def spy(tables, folder, version):
        seen.extend(path for new in left_over(spark) - files for path in glob.glob(f"{new}/*"))
        publish(tables, folder, version)

    monkeypatch.setattr(store, "publish", spy)
    placement.place_orders(batch, seed["menu_items"], seed["users"], str(tmp_path / "o"), 1, 0, 0)
    # The numbered orders, the judged lines and the rejects; not the checked or judged requests, nor the slices.
    assert len(seen) == 3


def test_a_batch_that_fails_leaves_nothing(spark, make):
    files, before = left_over(spark), settings(spark)
    with pytest.raises(ValueError), Scratch(spark) as scratch:
        assert rows_of(scratch(make("a INT", (1,)))) == [(1,)] and left_over(spark) != files
        raise ValueError
    assert left_over(spark) == files and settings(spark) == before


def test_only_orders_are_sorted_for_their_numbers(spark, seed, batch):
    written = []

    def keep(df):
        written.append(set(df.columns))
        return kept(df)

    priced = pricing.price_orders(batch, seed["menu_items"])
    lines = pricing.with_order_ids(priced, 0, 0, keep).lines
    assert written and not any("pos" in columns for columns in written)
    assert sorted(r.order_item_id for r in lines.collect()) == list(range(1, lines.count() + 1))


def test_requests_that_share_an_id_have_all_their_lines_each(spark, seed):
    twice = requests(spark, (1, [(1, 1)]), (1, [(1, 1), (2, 1)]), (2, [(1, 1), (77, 1)]), (2, [(1, 1)]), (None, [(1, 1)]))
    priced = pricing.price_orders(twice, seed["menu_items"])
    flat = pricing.price_lines(twice.drop("items"), pricing.request_lines(twice), seed["menu_items"])
    for nested, plain in zip(priced, flat):
        assert nested.columns == plain.columns and rows_of(nested) == rows_of(plain)
    assert rows_of(priced.rejects, "request_id", "reason") == [(None, NO_ITEMS), (2, GONE), (2, GONE)]
    done = pricing.with_order_ids(priced, 0, 0)
    assert rows_of(done.orders, "order_id", "total_amount") == [(1, D("27.97")), (2, D("27.97"))]
    assert rows_of(done.lines, "order_item_id", "order_id") == [(n, 1 + (n > 3)) for n in range(1, 7)]
