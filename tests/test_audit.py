"""Audit rows of a change lead from the old version to the new one."""

import pytest

from tests.conftest import NOW, rows_of
from tiffin.operators import changes
from tiffin.plans import queries
from tiffin.sources import base_tables as base
from tiffin.sources.audit import apply_audit, audit_changes, capture
from tiffin.sources.schemas import MODEL, fields
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "id INT, name STRING, price DECIMAL(10,2), on_sale BOOLEAN, at TIMESTAMP"


def captured(spark, before, after, key="id"):
    rows = capture(before, after, key, "thing", F.lit(NOW), 3, 10)
    audit = fields(MODEL["audit_logs"])
    assert {f.name: f.dataType for f in rows.schema} == {f.name: f.dataType for f in audit}
    return rows


def test_every_kind_of_change(spark, make):
    before = make(SCHEMA, (1, "a", None, True, NOW), (2, "b", None, None, NOW), (3, "same", None, None, None), (4, "gone", None, False, None))
    after = make(SCHEMA, (1, "a", None, None, None), (2, 'quote " \\ é', None, True, NOW), (3, "same", None, None, None), (5, None, None, None, None))
    rows = captured(spark, before, after)
    assert rows_of(rows, "log_id", "action", "entity_id") == [
        (11, "update", 1), (12, "update", 2), (13, "delete", 4), (14, "insert", 5),
    ]
    assert rows_of(audit_changes(rows).filter("entity_id = 1"), "field", "old_value", "new_value") == [
        ("at", "2024-03-10 12:00:00", None), ("on_sale", "true", None),
    ]
    assert rows_of(apply_audit(before, rows, "id")) == rows_of(after)
    back = captured(spark, after, before)
    assert rows_of(apply_audit(after, back, "id")) == rows_of(before)


def test_no_change_no_rows(spark, make):
    before = make(SCHEMA, (1, "a", None, True, NOW))
    assert captured(spark, before, before).count() == 0
    assert captured(spark, before.limit(0), before.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["orders", "menu_items", "categories"])
def test_published_changes_can_be_replayed(spark, table):
    m = base.model_from_base(spark, FOLDER)
    if table == "orders":
        key, after = "order_id", changes.apply_order_updates(m["orders"], queries.order_changes(m, spark, FOLDER)).state
    elif table == "menu_items":
        key, after = "item_id", changes.update_items(m["menu_items"], queries.item_changes(m, spark, FOLDER)).state
    else:
        given = queries.category_changes(m, spark, FOLDER)
        key, after = "category_id", changes.apply_category_changes(m["categories"], m["menu_items"], given).categories
    rows = captured(spark, m[table], after, key)
    assert rows.count() > 0
    assert rows_of(apply_audit(m[table], rows, key)) == rows_of(after.select(*m[table].columns))
