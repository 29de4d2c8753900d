"""Explicit schemas, as DDL text, of the six tables and of every message."""

from __future__ import annotations

from pyspark.sql.types import StructType

MODEL = {
    "users": (
        "user_id BIGINT, username STRING, email STRING, full_name STRING, phone STRING, role STRING, "
        "is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP, last_login TIMESTAMP"
    ),
    "categories": (
        "category_id INT, category_name STRING, description STRING, is_active BOOLEAN, "
        "created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "menu_items": (
        "item_id BIGINT, category_id INT, item_name STRING, description STRING, price DECIMAL(10,2), "
        "image_url STRING, is_available BOOLEAN, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "orders": (
        "order_id BIGINT, user_id BIGINT, order_number STRING, total_amount DECIMAL(12,2), "
        "payment_method STRING, payment_status STRING, status STRING, order_type STRING, "
        "scheduled_at TIMESTAMP, special_instructions STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "order_items": (
        "order_item_id BIGINT, order_id BIGINT, item_id BIGINT, quantity INT, unit_price DECIMAL(10,2), "
        "subtotal DECIMAL(12,2), item_name_snapshot STRING, created_at TIMESTAMP"
    ),
    "audit_logs": (
        "log_id BIGINT, user_id BIGINT, action STRING, entity_type STRING, entity_id BIGINT, "
        "old_values STRING, new_values STRING, ip_address STRING, created_at TIMESTAMP"
    ),
}


def fields(ddl: str) -> StructType:
    """The parsed schema; parsing needs an active session."""
    return StructType.fromDDL(ddl)


KEYS = {
    "users": "user_id",
    "categories": "category_id",
    "menu_items": "item_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "audit_logs": "log_id",
}

MESSAGES = {
    "order_request": (
        "request_id BIGINT, user_id BIGINT, items ARRAY<STRUCT<item_id: BIGINT, quantity: INT>>, "
        "payment_method STRING, special_instructions STRING, order_type STRING, scheduled_at STRING, ts TIMESTAMP"
    ),
    "cart": (
        "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, action STRING, item_id BIGINT, quantity INT"
    ),
    "cart_add": ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, payload STRING"),
    "order_new": (
        "orderId BIGINT, orderNumber STRING, totalAmount DECIMAL(12,2), userId BIGINT, username STRING, "
        "orderType STRING, scheduledAt TIMESTAMP, at TIMESTAMP, seq BIGINT"
    ),
    "order_update": (
        "order_id BIGINT, order_number STRING, user_id BIGINT, username STRING, full_name STRING, "
        "total_amount DECIMAL(12,2), status STRING, payment_status STRING, order_type STRING, "
        "scheduled_at TIMESTAMP, created_at TIMESTAMP, email STRING, status_sent BOOLEAN, at TIMESTAMP, seq BIGINT"
    ),
    "menu_change": (
        "op STRING, item_id BIGINT, payload MAP<STRING,STRING>, at TIMESTAMP, seq BIGINT"
    ),
    "category_change": (
        "op STRING, category_id INT, payload MAP<STRING,STRING>, at TIMESTAMP, seq BIGINT"
    ),
    "connection": ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, action STRING"),
    "request": (
        "ts TIMESTAMP, client STRING, method STRING, path STRING, status INT, duration_ms INT"
    ),
}
