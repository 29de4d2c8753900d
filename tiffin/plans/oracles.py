"""SQL twins of the registered queries, over the supplied tables."""

from __future__ import annotations

VIEWS = {
    "x_users": """
        SELECT c_custkey AS user_id, lower(replace(c_name, '#', '_')) AS username,
               concat(lower(replace(c_name, '#', '_')), '@example.org') AS email, c_name AS full_name,
               concat('+', lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), '-', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS phone,
               CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'customer' END AS role,
               c_acctbal >= 0 AS is_active
        FROM customer""",
    "x_categories": """
        SELECT DISTINCT CAST(substring(p_brand, 7) AS INT) AS category_id, p_brand AS category_name,
               CAST(substring(p_brand, 7) AS INT) % 5 <> 0 AS is_active
        FROM part""",
    "x_menu": """
        SELECT p_partkey AS item_id,
               CASE WHEN p_size = 1 THEN NULL ELSE CAST(substring(p_brand, 7) AS INT) END AS category_id,
               p_name AS item_name, CASE WHEN p_size % 13 <> 0 THEN p_type END AS description,
               CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               CASE WHEN p_size % 3 <> 0 THEN concat('/img/', p_partkey) END AS image_url,
               p_size % 7 <> 0 AS is_available, p_size % 11 <> 0 AS is_active
        FROM part""",
    "x_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS user_id,
               concat('ORD', lpad(CAST(o_orderkey AS VARCHAR), 13, '0')) AS order_number,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
               CASE WHEN o_orderkey % 2 = 0 THEN 'cash' ELSE 'card' END AS payment_method,
               CASE WHEN o_orderstatus = 'F' THEN 'paid'
                    WHEN o_orderstatus = 'P' AND substring(o_orderpriority, 1, 1) = '4' THEN 'refunded'
                    ELSE 'pending' END AS payment_status,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE
                 CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'confirmed' WHEN '2' THEN 'preparing'
                      WHEN '3' THEN 'ready' WHEN '4' THEN 'cancelled' ELSE 'pending' END END AS status,
               CASE WHEN o_orderkey % 4 = 0 THEN 'scheduled' ELSE 'asap' END AS order_type,
               CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS scheduled_at,
               CASE WHEN o_orderkey % 5 = 0 THEN concat('Note ', o_orderpriority) END AS special_instructions,
               o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders""",
    "x_items": """
        SELECT CAST(l_linenumber AS BIGINT) AS order_item_id, l_orderkey AS order_id, l_partkey AS item_id,
               CAST(l_quantity AS INT) AS quantity,
               CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) * CAST(0.01 AS DECIMAL(3,2))
                    AS DECIMAL(10,2)) AS unit_price,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal,
               CASE l_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN concat('Snapshot ', l_partkey) END AS item_name_snapshot
        FROM lineitem""",
    "x_figures": """
        SELECT order_id, count(*) AS line_count, CAST(sum(quantity) AS BIGINT) AS unit_count
        FROM x_items GROUP BY order_id""",
    "x_order_figures": """
        SELECT o.*, coalesce(f.line_count, 0) AS line_count, f.unit_count,
               coalesce(f.unit_count, 0) AS unit_count_or_zero
        FROM x_orders o LEFT JOIN x_figures f ON f.order_id = o.order_id""",
    "x_events": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "x_priced": """
        SELECT i.order_id AS request_id, i.order_item_id AS pos, i.item_id, i.quantity, m.price AS unit_price,
               CAST(m.price * i.quantity AS DECIMAL(12,2)) AS subtotal,
               CASE WHEN m.item_id IS NULL OR m.is_active = false THEN
                    concat('Item "', coalesce(m.item_name, CAST(i.item_id AS VARCHAR)),
                           '" is no longer available. Please remove it from your cart.') END AS reason
        FROM x_items i LEFT JOIN x_menu m ON m.item_id = i.item_id""",
    "x_verdicts": """
        SELECT request_id, CAST(sum(subtotal) AS DECIMAL(12,2)) AS total_amount,
               (array_agg(reason ORDER BY pos, item_id) FILTER (WHERE reason IS NOT NULL))[1] AS reason
        FROM x_priced GROUP BY request_id""",
    "x_placements": """
        SELECT o.order_id AS request_id, o.user_id, o.order_type, o.scheduled_at, o.created_at, v.total_amount,
               concat('ORD', CAST(epoch_ms(o.created_at) AS VARCHAR), '-', o.order_id) AS order_number,
               CASE WHEN o.order_id % 16 = 0 THEN 'Invalid or past scheduled time.'
                    WHEN v.request_id IS NULL THEN 'Order must contain at least one item'
                    WHEN o.order_id % 10 = 0 THEN 'Payment method is required' ELSE v.reason END AS reason
        FROM x_orders o LEFT JOIN x_verdicts v ON v.request_id = o.order_id""",
    "x_placed": """
        SELECT *, row_number() OVER (ORDER BY created_at, request_id) AS order_id FROM x_placements WHERE reason IS NULL""",
    "x_order_changes": """
        SELECT CASE WHEN event_id % 50 = 0 THEN -event_id - 1 ELSE user_id * 3 + k END AS order_id,
               CASE k % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'lost' WHEN 3 THEN 'completed' END AS status,
               CASE k % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'refunded' WHEN 2 THEN 'unknown' END AS payment_status,
               event_id AS seq
        FROM x_events""",
    "x_category_changes": """
        SELECT k % 40 AS category_id,
               CASE event_id % 3 WHEN 0 THEN concat('Renamed ', k) END AS category_name,
               CASE WHEN event_id % 4 = 0 THEN k % 2 = 0 END AS is_active, event_id AS seq
        FROM x_events WHERE event_type = 'signup'""",
    "x_asked_categories": """
        SELECT event_id, category_name, is_active, row_number() OVER (PARTITION BY category_name ORDER BY event_id) AS nth,
               upper(category_name) IN (SELECT upper(category_name) FROM x_categories) AS stored
        FROM (SELECT event_id, CASE WHEN k % 4 = 0 THEN concat('BRAND#', k % 60) ELSE concat('Season ', k) END AS category_name,
                     CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END AS is_active
              FROM x_events WHERE event_type = 'signup')""",
    "x_category_last": """
        SELECT category_id, arg_max(category_name, seq) FILTER (WHERE category_name IS NOT NULL) AS new_name,
               arg_max(is_active, seq) FILTER (WHERE is_active IS NOT NULL) AS new_active
        FROM x_category_changes GROUP BY category_id""",
    "x_item_changes": """
        SELECT user_id * 20 + k - 10 AS item_id, k % 4 AS category_id, concat('Item ', k) AS item_name,
               CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'new text' END AS description,
               CAST(k + 0.25 AS DECIMAL(10,2)) AS price,
               CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END AS is_available, event_id AS seq
        FROM x_events WHERE event_type = 'error'""",
    "x_signups": """
        SELECT user_id AS request_id,
               CASE user_id % 11 WHEN 0 THEN concat(' ', substring(username, 1, 2), ' ')
                    WHEN 1 THEN concat(username, '-more') WHEN 2 THEN concat(chr(9), username, chr(10))
                    WHEN 3 THEN concat(substring(username, 1, 1), chr(9), chr(9)) ELSE username END AS username,
               CASE WHEN user_id % 6 = 0 THEN replace(email, '@', '') WHEN user_id % 6 = 1 THEN concat('o', chr(39), email)
                    WHEN user_id % 18 = 2 THEN concat('a..', email)
                    WHEN user_id % 18 = 8 THEN replace(email, '@', '@-') ELSE email END AS email,
               CASE user_id % 8 WHEN 0 THEN 'J' WHEN 1 THEN NULL ELSE full_name END AS full_name,
               CASE user_id % 5 WHEN 0 THEN 'call me' WHEN 1 THEN NULL ELSE phone END AS phone,
               CASE user_id % 4 WHEN 0 THEN 'staff' WHEN 1 THEN NULL ELSE role END AS role
        FROM x_users""",
    "x_item_requests": """
        SELECT item_id AS request_id,
               CASE item_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN repeat(item_name, 12) ELSE item_name END AS item_name,
               CASE item_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'free' WHEN 2 THEN '-1.5' ELSE CAST(price AS VARCHAR) END AS price,
               CASE WHEN item_id % 7 = 0 THEN 'x1' ELSE CAST(category_id AS VARCHAR) END AS category_id,
               CASE WHEN item_id % 6 = 0 THEN repeat(item_name, 60) ELSE description END AS description,
               CASE item_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'true' END AS flag,
               CASE item_id % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN 'true' WHEN 2 THEN 'TRUE' END AS is_active
        FROM x_menu""",
    "x_gone_users": "SELECT user_id FROM x_users WHERE NOT is_active",
    "x_kept_orders": """
        SELECT * FROM x_orders WHERE status <> 'cancelled' AND user_id NOT IN (SELECT user_id FROM x_gone_users)""",
    "x_kept_lines": """
        SELECT * FROM x_items i
        WHERE NOT EXISTS (SELECT 1 FROM x_orders o WHERE o.order_id = i.order_id
                          AND (o.status = 'cancelled' OR o.user_id IN (SELECT user_id FROM x_gone_users)))""",
    "x_used_items": """
        SELECT DISTINCT m.item_id FROM x_menu m JOIN x_kept_lines l ON l.item_id = m.item_id WHERE NOT m.is_available""",
    "x_kept_items": """
        SELECT m.item_id, CASE WHEN c.category_id IS NULL THEN m.category_id END AS category_id
        FROM x_menu m LEFT JOIN x_categories c ON c.category_id = m.category_id AND NOT c.is_active
        WHERE m.is_available OR m.item_id IN (SELECT item_id FROM x_used_items)""",
    "x_history": """
        SELECT l_orderkey AS order_id, l_shipdate AS "at", l_linenumber * 100000000::BIGINT + l_partkey AS seq,
               CASE l_linenumber WHEN 1 THEN 'pending' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'preparing'
                    WHEN 4 THEN 'ready' WHEN 5 THEN 'completed' WHEN 6 THEN 'cancelled' ELSE 'lost' END AS status
        FROM lineitem""",
    "x_cart_messages": """
        SELECT event_id, ts, user_id,
               CASE k % 7 WHEN 0 THEN 'not json' WHEN 1 THEN concat('{"item": {"quantity": ', k, '}}')
                    WHEN 2 THEN concat('{"item": {"item_id": "', k, '"}}') WHEN 3 THEN concat('{"item": {"item_id": ', k, '}}')
                    ELSE CASE k % 14 WHEN 4 THEN concat('{"item": {"item_id": ', k, '.5, "quantity": 2}}')
                              WHEN 11 THEN concat('{"item": {"item_id": ', k, '.0, "quantity": 2}}')
                              WHEN 5 THEN '{"x": 1}'
                              ELSE concat('{"item": {"item_id": ', k, ', "quantity": 3}}') END END AS payload, k
        FROM x_events WHERE event_type = 'click'""",
    "x_cart_checked": """
        SELECT *, CASE WHEN object AND json_type(payload, '$.item.item_id') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
                       THEN TRY_CAST(json_extract_string(payload, '$.item.item_id') AS DOUBLE) END AS id_number,
               CASE WHEN object THEN TRY_CAST(json_extract_string(payload, '$.item.quantity') AS INT) END AS quantity
        FROM (SELECT *, CASE WHEN json_valid(payload) THEN json_type(payload) IN ('OBJECT', 'ARRAY') ELSE FALSE END AS object
              FROM x_cart_messages)""",
    "x_cart": """
        SELECT event_id, ts, user_id,
               CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'set' WHEN 'error' THEN 'remove' ELSE 'clear' END AS action,
               CASE WHEN event_type IN ('click', 'view', 'error') THEN CAST(k % 10 AS BIGINT) END AS item_id,
               CASE WHEN event_type = 'view' THEN k % 4 END AS quantity
        FROM x_events""",
    "x_requests": """
        SELECT event_id, ts, CAST(user_id AS VARCHAR) AS client,
               CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'POST' ELSE 'GET' END AS method,
               CASE event_type WHEN 'purchase' THEN '/api/orders' WHEN 'signup' THEN '/api/auth/register'
                    WHEN 'click' THEN '/api/cart' WHEN 'view' THEN '/api/menu' ELSE '/api/orders/my-orders' END AS path,
               CASE WHEN event_type = 'error' THEN 500 WHEN k % 20 = 0 THEN 404 ELSE 200 END AS status,
               CAST(floor(value * 10) AS INT) AS duration_ms
        FROM x_events""",
    "x_limited": """
        SELECT make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 600) AS ts,
               concat('10.0.0.', CAST(client AS BIGINT) % 4) AS client, l.*
        FROM x_requests JOIN (VALUES ('all', 100, INTERVAL 15 MINUTE, '%'), ('sign_in', 10, INTERVAL 15 MINUTE, '/api/auth/%'),
                                     ('order', 3, INTERVAL 1 MINUTE, '/api/orders')) l(limit_name, most, step, covers)
          ON path LIKE covers""",
    "x_connections": """
        SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'connect' ELSE 'disconnect' END AS action
        FROM events WHERE event_type IN ('view', 'error', 'signup')""",
    "x_cart_all": """
        SELECT event_id, user_id, action, item_id, quantity FROM x_cart""",
    "x_menu_changes": """
        SELECT user_id * 14 + k % 14 AS item_id, event_id AS seq, event_type AS kind, k,
               k % 2 = 0 OR event_type = 'click' AS has_name, concat('Name ', event_id) AS new_name,
               k % 3 = 0 AS has_price, CAST(k + 0.5 AS DECIMAL(10,2)) AS new_price,
               k % 5 = 0 AS has_text, CASE WHEN k % 10 = 0 THEN 'changed' END AS new_text,
               k % 7 = 0 AS has_available, k % 14 = 0 AS new_available,
               event_type IN ('purchase', 'signup') OR (event_type = 'click' AND k % 11 = 0) AS has_active,
               event_type = 'signup' AS new_active
        FROM x_events""",
    "x_closed": "SELECT max(ts) - INTERVAL 10 MINUTE AS until FROM events",
    "x_sessions": """
        SELECT user_id, ts AS started_at, CASE WHEN following = 'disconnect' THEN next_ts END AS ended_at,
               CASE WHEN following = 'disconnect' THEN epoch_us(next_ts) // 1000 - epoch_us(ts) // 1000 END AS duration_ms,
               CASE following WHEN 'disconnect' THEN 'closed' WHEN 'connect' THEN 'superseded' ELSE 'live' END AS state,
               next_ts
        FROM (SELECT *, lead(action) OVER w AS following, lead(ts) OVER w AS next_ts FROM x_connections
              WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE action = 'connect'""",
    "x_violations": """
        SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
               time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end, client, count(*) AS requests
        FROM x_requests GROUP BY ALL HAVING count(*) > 1""",
    "x_metrics": """
        SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, method, path, count(*) AS requests,
               count(*) FILTER (WHERE status >= 400) AS errors,
               CAST(sum(duration_ms) AS DOUBLE) / count(*) AS mean_ms, quantile_disc(duration_ms, 0.95) AS p95_ms
        FROM x_requests GROUP BY ALL""",
}

_MENU = """SELECT m.*, c.category_name FROM x_menu m JOIN x_categories c ON c.category_id = m.category_id
           WHERE m.is_active AND c.is_active"""
_ITEM_UNITS = """SELECT m.item_id, m.item_name, m.image_url, c.category_name,
                        CAST(sum(i.quantity) AS BIGINT) AS total_quantity_ordered
                 FROM x_menu m LEFT JOIN x_items i ON i.item_id = m.item_id
                 LEFT JOIN x_categories c ON c.category_id = m.category_id GROUP BY ALL"""
_NEWEST = "ORDER BY created_at DESC, order_id DESC"
_FEED = """SELECT o.order_id, o.order_number, CAST(o.total_amount AS DOUBLE) AS total_amount, o.payment_method, o.status,
                  o.payment_status, o.order_type, o.scheduled_at, o.created_at, o.user_id, u.username, u.full_name, o.line_count
           FROM x_order_figures o LEFT JOIN x_users u ON u.user_id = o.user_id
           ORDER BY o.created_at DESC, o.order_id DESC LIMIT 20"""
_SUMMARY = """SELECT o.order_id, o.order_number, CAST(o.total_amount AS DOUBLE) AS total_amount, o.status, o.payment_status,
                     o.created_at, u.username, u.full_name, o.line_count
              FROM x_order_figures o LEFT JOIN x_users u ON u.user_id = o.user_id"""
# Mean in millionths, rounded half up in whole numbers, as DECIMAL division does.
_SALES = """count(*) AS total_orders, count(DISTINCT user_id) AS unique_customers,
            CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
            CAST((CAST(sum(total_amount) * 100 AS HUGEINT) * 20000 + count(*)) // nullif(2 * count(*), 0) AS DOUBLE) / 1000000
              AS avg_order_value"""
_CUSTOMER_HEADER = """o.order_id, o.order_number, CAST(o.total_amount AS DOUBLE) AS total_amount, o.payment_method, o.status,
                      o.payment_status, o.special_instructions, o.created_at"""


def _kpis(source: str) -> str:
    return f"""SELECT count(*) AS total_orders, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
                      count(*) FILTER (WHERE status = 'pending') AS pending_orders,
                      (SELECT count(*) FROM ({_MENU})) AS menu_items FROM {source}"""


def _search(term: str, category: int | None) -> str:
    only = "" if category is None else f" AND category_id = {category}"
    return f"""SELECT item_id, category_id, item_name, CAST(price AS DOUBLE) AS price FROM ({_MENU})
               WHERE contains(lower(item_name), '{term}'){only}"""


def _buttons(role: str) -> str:
    return f"""SELECT item_id, CASE WHEN NOT is_active THEN 'Removed' WHEN NOT is_available THEN 'Unavailable'
                      WHEN '{role}' <> 'customer' THEN 'Customers Only' ELSE 'Add to Cart' END AS button FROM x_menu"""


def _errors(source: str, rules: list[tuple[str, str, str]]) -> str:
    """One row per broken rule, with the first message of the row."""
    parts = [
        f"SELECT request_id, {n} AS n, '{field}' AS field, '{text}' AS message FROM {source} WHERE {broken}"
        for n, (field, broken, text) in enumerate(rules)
    ]
    return f"""SELECT request_id, first_value(message) OVER (PARTITION BY request_id ORDER BY n) AS first_error,
                      field, message FROM ({' UNION ALL '.join(parts)})"""


# Atoms joined by single dots; labels without hyphens at their ends; a last label of letters.
_ATOM = "[a-zA-Z0-9!#$%&''*+/=?^_`{|}~-]+"
_EMAIL = rf"^{_ATOM}(\.{_ATOM})*@([a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,63}}$"
_NAME = r"regexp_replace(username, '^\s+|\s+$', '', 'g')"
_LIVE_RULES = [
    ("username", f"length({_NAME}) < 3", "Username must be at least 3 characters"),
    ("email", f"NOT regexp_matches(email, '{_EMAIL}')", "Invalid email address"),
    ("role", "role NOT IN ('customer', 'admin')", "Invalid role specified"),
]
_STRICT_RULES = [
    ("username", f"length({_NAME}) NOT BETWEEN 3 AND 20", "Username must be 3-20 characters"),
    (
        "username",
        f"NOT regexp_matches({_NAME}, '^[a-zA-Z0-9_]+$')",
        "Username can only contain letters, numbers, and underscores",
    ),
    ("email", f"NOT regexp_matches(email, '{_EMAIL}')", "Invalid email format"),
    (
        "full_name",
        "coalesce(length(full_name), 0) NOT BETWEEN 2 AND 100",
        "Full name must be 2-100 characters",
    ),
    ("phone", r"NOT regexp_matches(phone, '^[0-9\-+\s]+$')", "Invalid phone format"),
]
_ITEM_RULES = [
    ("item_name", "trim(item_name) = ''", "Item name is required"),
    ("item_name", "length(trim(item_name)) NOT BETWEEN 1 AND 100", "Item name must be 1-100 characters"),
    ("price", "price = ''", "Price is required"),
    (
        "price",
        "coalesce(TRY_CAST(price AS DOUBLE), 0) <= 0",
        "Price must be a valid number greater than 0",
    ),
    ("category_id", "trim(category_id) <> '' AND TRY_CAST(category_id AS DOUBLE) IS NULL", "Invalid category ID"),
    ("description", "length(description) > 500", "Description must be less than 500 characters"),
    ("is_available", "flag NOT IN ('true', 'false')", "is_available must be a boolean"),
]
_CATEGORY_RULES = [
    (
        "category_name",
        "length(trim(item_name)) NOT BETWEEN 1 AND 100",
        "Category name required (1-100 chars)",
    ),
    ("is_active", "is_active NOT IN ('true', 'false', '1', '0')", "is_active must be boolean"),
]


def _rule(table: str, view: str, rule: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER (WHERE {condition}) AS violations FROM {view}"
    )


def _unique(table: str, view: str, column: str, text: bool) -> str:
    value = f"lower(rtrim({column}))" if text else column
    return (
        f"SELECT '{table}' AS table_name, 'unique {column}' AS rule, "
        f"count({column}) - count(DISTINCT {value}) AS violations FROM {view}"
    )


def _foreign(table: str, view: str, column: str, parent: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'foreign key {column}' AS rule, count(*) AS violations FROM {view} v "
        f"WHERE v.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{column} = v.{column})"
    )


def _constraints() -> str:
    views = {
        "users": "x_users",
        "categories": "x_categories",
        "menu_items": "x_menu",
        "orders": "x_orders",
        "order_items": "x_items",
    }
    not_null = {
        "users": "username email full_name role",
        "categories": "category_name",
        "menu_items": "item_name price",
        "orders": "user_id order_number total_amount payment_method payment_status status",
        "order_items": "order_id item_id quantity unit_price subtotal",
    }
    parts = [_rule(t, views[t], f"not null {c}", f"{c} IS NULL") for t, cs in not_null.items() for c in cs.split()]
    parts += [
        _rule("menu_items", "x_menu", "check price", "price < 0"),
        _rule("orders", "x_orders", "check total_amount", "total_amount <= 0"),
        _rule("order_items", "x_items", "check quantity", "quantity <= 0"),
        _rule("order_items", "x_items", "check unit_price", "unit_price <= 0"),
        _rule("order_items", "x_items", "check subtotal", "subtotal <= 0"),
        _rule("users", "x_users", "enum role", "role NOT IN ('customer', 'admin')"),
        _rule(
            "orders",
            "x_orders",
            "enum status",
            "status NOT IN ('pending', 'confirmed', 'preparing', 'ready', 'completed', 'cancelled')",
        ),
        _rule("orders", "x_orders", "enum payment_status", "payment_status NOT IN ('pending', 'paid', 'refunded')"),
        _rule("orders", "x_orders", "enum order_type", "order_type NOT IN ('asap', 'scheduled')"),
        _rule("users", "x_users", "length username", "length(username) > 20"),
        _rule("users", "x_users", "length email", "length(email) > 100"),
        _rule("users", "x_users", "length full_name", "length(full_name) > 100"),
        _rule("users", "x_users", "length phone", "length(phone) > 20"),
        _rule("categories", "x_categories", "length category_name", "length(category_name) > 100"),
        _rule("menu_items", "x_menu", "length item_name", "length(item_name) > 100"),
        _rule("menu_items", "x_menu", "length image_url", "length(image_url) > 500"),
        _rule("orders", "x_orders", "length order_number", "length(order_number) > 50"),
        _rule("orders", "x_orders", "length payment_method", "length(payment_method) > 50"),
        _unique("users", "x_users", "user_id", False),
        _unique("users", "x_users", "username", True),
        _unique("users", "x_users", "email", True),
        _unique("categories", "x_categories", "category_id", False),
        _unique("categories", "x_categories", "category_name", True),
        _unique("menu_items", "x_menu", "item_id", False),
        _unique("orders", "x_orders", "order_id", False),
        _unique("orders", "x_orders", "order_number", True),
        _unique("order_items", "x_items", "order_item_id", False),
        _foreign("menu_items", "x_menu", "category_id", "x_categories"),
        _foreign("orders", "x_orders", "user_id", "x_users"),
        _foreign("order_items", "x_items", "order_id", "x_orders"),
        _foreign("order_items", "x_items", "item_id", "x_menu"),
    ]
    return " UNION ALL ".join(parts)


BODIES = {
    # Catalog
    "categories_all": "SELECT * FROM x_categories ORDER BY category_name",
    "active_categories": "SELECT * FROM x_categories WHERE is_active ORDER BY category_name",
    "items_by_id": """SELECT item_id, item_name, CAST(price AS DOUBLE) AS price, is_available FROM x_menu
        WHERE is_active AND item_id IN (SELECT item_id FROM x_cart WHERE item_id IS NOT NULL)""",
    "items_in": """SELECT item_id, CAST(price AS DOUBLE) AS price, is_active, item_name FROM x_menu
        WHERE item_id IN (SELECT i.item_id FROM x_items i JOIN x_orders o ON o.order_id = i.order_id
                          WHERE o.status = 'pending')""",
    "menu_catalog": f"SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM ({_MENU})",
    "available_menu": """SELECT m.item_id, m.item_name, m.description, CAST(m.price AS DOUBLE) AS price, m.image_url,
               c.category_id, c.category_name
        FROM x_menu m JOIN x_categories c ON c.category_id = m.category_id WHERE m.is_available AND c.is_active""",
    "item_with_category": """SELECT m.* REPLACE (CAST(price AS DOUBLE) AS price), c.category_name
        FROM x_menu m LEFT JOIN x_categories c ON c.category_id = m.category_id""",
    "menu_search": _search("ring", 7),
    "menu_search_all": _search("blue", None),
    "active_or_unknown_items": """SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN is_active END AS is_active FROM x_menu
        WHERE item_id % 7 = 0 OR is_active""",
    "order_button_customer": _buttons("customer"),
    "order_button_admin": _buttons("admin"),
    "first_menu_items": f"""SELECT item_id, item_name, category_name, CAST(price AS DOUBLE) AS price, is_available
        FROM ({_MENU}) ORDER BY category_name, item_name, item_id LIMIT 5""",
    # Accounts
    "user_profiles": "SELECT user_id, username, email, full_name, phone, role FROM x_users",
    "users_per_role": "SELECT role, count(*) AS user_count FROM x_users GROUP BY role",
    "resolve_users": """SELECT e.event_id AS login_id, u.user_id, u.username, u.email, u.role, u.full_name,
               CASE e.event_id % 3 WHEN 0 THEN 'username' ELSE 'email' END AS matched_on
        FROM events e JOIN x_users u ON u.user_id = e.user_id WHERE e.event_id % 3 <> 2""",
    # Orders
    "orders_of_customers": """SELECT order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, status
        FROM x_orders WHERE user_id IN (SELECT user_id FROM x_gone_users)""",
    "pending_orders": """SELECT order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount
        FROM x_orders WHERE status = 'pending'""",
    "completed_on_day": """SELECT order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, created_at
        FROM x_orders WHERE status = 'completed' AND CAST(created_at AS DATE) = DATE '1998-10-03'""",
    "line_figures": "SELECT order_id, line_count, unit_count, unit_count_or_zero FROM x_order_figures",
    "orders_per_user": "SELECT user_id, count(*) AS order_count FROM x_orders GROUP BY user_id",
    "order_history": """SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM x_order_figures
        WHERE user_id IN (SELECT user_id FROM x_gone_users)""",
    "order_history_page": f"""SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM x_order_figures
        WHERE user_id = 7 {_NEWEST} LIMIT 20""",
    "page_with_total": f"""SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount),
               (SELECT count(*) FROM x_orders WHERE user_id = 7) AS total_count
        FROM x_order_figures WHERE user_id = 7 {_NEWEST} LIMIT 3 OFFSET 3""",
    "order_pages": """SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id DESC) AS INT) AS row_number,
                   count(*) OVER (PARTITION BY user_id) AS total_count FROM x_order_figures)
        WHERE row_number BETWEEN 6 AND 10""",
    "order_pages_by_day": """SELECT * FROM (SELECT order_id, status, created_at,
               CAST(row_number() OVER (PARTITION BY status ORDER BY created_at DESC, order_id DESC) AS INT) AS row_number
            FROM x_orders) WHERE row_number BETWEEN 1401 AND 2100""",
    "admin_order_feed": _FEED,
    "admin_order_feed_p2": _FEED + " OFFSET 20",
    "order_page": f"""SELECT order_id, order_number, CAST(total_amount AS DOUBLE) AS total_amount, created_at
        FROM x_orders {_NEWEST} LIMIT 20 OFFSET 40""",
    "order_pages_large": f"""SELECT order_id, order_number, created_at FROM x_orders {_NEWEST} LIMIT 3000 OFFSET 3000""",
    "order_page_undated": """SELECT order_id, order_number, created_at FROM (
            SELECT order_id, order_number, CASE WHEN order_id % 10 <> 0 THEN created_at END AS created_at FROM x_orders)
        ORDER BY created_at DESC NULLS LAST, order_id DESC LIMIT 20
        OFFSET (SELECT 20 * (count(*) // 20 - 3) FROM x_orders)""",
    "page_total": """SELECT user_id, count(*) AS total_count FROM x_orders WHERE user_id = 7 GROUP BY user_id""",
    "order_documents_parts": """SELECT order_id, part, parts, count(*) AS lines,
               min(order_item_id) AS first_id, max(order_item_id) AS last_id FROM (
            SELECT order_id, order_item_id, CAST((place - 1) // 2 + 1 AS INT) AS part,
                   CAST((count(*) OVER (PARTITION BY order_id) - 1) // 2 + 1 AS INT) AS parts
            FROM (SELECT order_id, order_item_id,
                         row_number() OVER (PARTITION BY order_id ORDER BY order_item_id) AS place
                  FROM x_items WHERE order_id IN (SELECT order_id FROM x_orders)))
        GROUP BY order_id, part, parts""",
    "order_page_far": f"""SELECT order_id, order_number, created_at FROM x_orders {_NEWEST} LIMIT 10 OFFSET 1190""",
    "order_page_after": f"""SELECT order_id, order_number, created_at FROM x_orders
        WHERE created_at < TIMESTAMP '1999-01-16' OR (created_at = TIMESTAMP '1999-01-16' AND order_id < 2)
        {_NEWEST} LIMIT 20""",
    "order_page_after_oldest": """SELECT * FROM (
            SELECT order_id, order_number, CASE WHEN order_id % 10 <> 0 THEN created_at END AS created_at FROM x_orders)
        WHERE created_at IS NULL OR created_at < (SELECT min(created_at) + INTERVAL 1 DAY FROM x_orders WHERE order_id % 10 <> 0)
        ORDER BY created_at DESC NULLS LAST, order_id DESC LIMIT 60""",
    "order_page_after_undated": """SELECT order_id, order_number, CAST(NULL AS TIMESTAMP) AS created_at FROM x_orders
        WHERE order_id % 10 = 0 AND order_id < 5000 ORDER BY order_id DESC LIMIT 20""",
    "recent_five": f"""SELECT order_id, order_number, CAST(total_amount AS VARCHAR) AS total, upper(status) AS status
        FROM (SELECT * FROM x_orders {_NEWEST} LIMIT 5)""",
    "recent_orders": """SELECT o.order_id, o.order_number, CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
               o.payment_status, o.created_at, o.user_id, u.username, u.full_name, u.email, o.line_count
        FROM x_order_figures o LEFT JOIN x_users u ON u.user_id = o.user_id""",
    "order_summary": _SUMMARY + " WHERE o.order_id IN (1, 2, 3, 5, 8, 13, 999999999)",
    "order_summary_bulk": _SUMMARY + " WHERE o.status = 'cancelled'",
    "order_update_rows": """SELECT o.order_id, o.order_number, o.user_id, u.username, u.full_name,
               CAST(o.total_amount AS DOUBLE) AS total_amount, o.status, o.payment_status, o.order_type, o.scheduled_at,
               o.created_at, u.email
        FROM x_orders o JOIN x_users u ON u.user_id = o.user_id WHERE o.status = 'ready'""",
    "order_labels": """SELECT o.order_id,
               CASE o.order_id % 3 WHEN 0 THEN concat('User #', o.user_id) ELSE u.full_name END AS customer,
               CASE WHEN o.order_id % 7 = 0 THEN 'PENDING' ELSE upper(o.status) END AS status_text,
               CASE WHEN o.order_id % 5 = 0 THEN 'N/A' ELSE upper(o.payment_method) END AS payment_text,
               CASE WHEN o.order_id % 9 = 0 THEN 'UNKNOWN' ELSE upper(o.payment_status) END AS paid_text,
               CASE WHEN o.status = 'pending' THEN 'waiting' WHEN o.status = 'completed' THEN 'done'
                    WHEN o.status = 'cancelled' THEN 'failed' ELSE 'active' END AS bucket,
               CASE o.payment_status WHEN 'pending' THEN 'waiting' WHEN 'paid' THEN 'done' ELSE 'failed' END AS payment_bucket,
               CAST(o.total_amount AS VARCHAR) AS amount_text,
               coalesce(CASE WHEN CAST(o.scheduled_at AS DATE) = DATE '1998-10-04' THEN strftime(o.scheduled_at, 'Today @ %I:%M %p')
                    ELSE strftime(o.scheduled_at, '%b %-d @ %I:%M %p') END, 'N/A') AS schedule_text,
               coalesce(CASE WHEN CAST(o.scheduled_at AS DATE) = DATE '1998-10-04'
                    THEN strftime(o.scheduled_at, 'Scheduled for Today at %I:%M %p')
                    ELSE strftime(o.scheduled_at, 'Scheduled for %b %-d at %I:%M %p') END, 'ASAP') AS customer_schedule
        FROM x_orders o LEFT JOIN x_users u ON u.user_id = o.user_id""",
    # Documents
    "customer_order_lines": """SELECT o.order_id, o.order_number, o.status, i.order_item_id, i.item_id, i.quantity,
               CAST(i.unit_price AS DOUBLE) AS unit_price, CAST(i.subtotal AS DOUBLE) AS subtotal, m.item_name, m.image_url
        FROM x_orders o JOIN x_items i ON i.order_id = o.order_id LEFT JOIN x_menu m ON m.item_id = i.item_id""",
    "customer_order_documents": f"""SELECT {_CUSTOMER_HEADER}, o.line_count AS items
        FROM x_order_figures o WHERE o.user_id = 7""",
    "owned_order_documents": """SELECT order_id, line_count AS items FROM x_order_figures
        WHERE user_id = 7 AND status = 'completed'""",
    "order_lines_flat": """SELECT o.order_number, u.username, o.unit_count_or_zero, i.order_item_id, i.item_id,
               CASE WHEN i.item_name_snapshot = '' THEN concat('Item Not Found (ID: ', i.item_id, ')')
                    ELSE coalesce(i.item_name_snapshot, m.item_name) END AS item_name,
               coalesce(m.description, 'No description available.') AS description,
               CAST(i.quantity AS BIGINT) AS quantity, CAST(i.unit_price AS DOUBLE) AS price,
               CAST(i.subtotal AS DOUBLE) AS subtotal, m.image_url
        FROM x_order_figures o JOIN x_items i ON i.order_id = o.order_id LEFT JOIN x_menu m ON m.item_id = i.item_id
        LEFT JOIN x_users u ON u.user_id = o.user_id""",
    "admin_order_headers": """SELECT o.order_id, o.order_number, u.user_id, u.username, u.full_name, u.email, u.phone,
               CAST(o.total_amount AS DOUBLE) AS total_amount, o.payment_method, o.status, o.payment_status, o.order_type,
               o.scheduled_at, o.special_instructions, o.created_at, o.updated_at, o.unit_count_or_zero,
               o.line_count AS items
        FROM x_order_figures o LEFT JOIN x_users u ON u.user_id = o.user_id""",
    # Sales
    "daily_sales": f"""SELECT CAST(created_at AS DATE) AS sale_date, {_SALES} FROM x_orders
        WHERE status = 'completed' GROUP BY 1""",
    "daily_sales_day": f"""SELECT max(CAST(created_at AS DATE)) AS sale_date, {_SALES} FROM x_orders
        WHERE status = 'completed' AND CAST(created_at AS DATE) = DATE '1998-10-03'""",
    "daily_sales_empty": f"""SELECT max(CAST(created_at AS DATE)) AS sale_date, {_SALES} FROM x_orders
        WHERE status = 'completed' AND CAST(created_at AS DATE) = DATE '1990-01-01'""",
    "top_selling": """SELECT m.item_id, m.item_name, CAST(sum(i.quantity) AS BIGINT) AS total_quantity_sold,
               CAST(sum(i.subtotal) AS DOUBLE) AS total_revenue, count(DISTINCT i.order_id) AS times_ordered
        FROM x_items i JOIN x_menu m ON m.item_id = i.item_id GROUP BY m.item_id, m.item_name
        ORDER BY total_quantity_sold DESC, m.item_id LIMIT 10""",
    "item_order_counts": _ITEM_UNITS,
    "preparation_ranking": f"""SELECT *, row_number() OVER (ORDER BY total_quantity_ordered DESC NULLS LAST, item_name, item_id) <= 3
               AS is_top FROM ({_ITEM_UNITS})""",
    "overview_kpis_all": _kpis("x_orders"),
    "overview_kpis_page": _kpis(f"(SELECT * FROM x_orders {_NEWEST} LIMIT 20)"),
    # Pricing and changes
    "price_orders_valid": """SELECT o.order_id AS request_id, o.user_id,
               concat('ORD', CAST(epoch_ms(o.created_at) AS VARCHAR), '-', o.order_id) AS order_number,
               CAST(v.total_amount AS DOUBLE) AS total_amount, o.payment_method, 'pending' AS payment_status,
               'pending' AS status, o.order_type, o.scheduled_at, o.special_instructions, o.created_at,
               o.created_at AS updated_at
        FROM x_orders o JOIN x_verdicts v ON v.request_id = o.order_id WHERE v.reason IS NULL""",
    "price_orders_numbered": """SELECT o.order_id AS request_id, CAST(v.total_amount AS DOUBLE) AS total_amount,
               (SELECT max(order_id) FROM x_orders) + row_number() OVER (ORDER BY o.created_at, o.order_id) AS order_id
        FROM x_orders o JOIN x_verdicts v ON v.request_id = o.order_id WHERE v.reason IS NULL""",
    "price_orders_lines": """SELECT p.request_id, p.pos, p.item_id, p.quantity, CAST(p.unit_price AS DOUBLE) AS unit_price,
               CAST(p.subtotal AS DOUBLE) AS subtotal
        FROM x_priced p JOIN x_verdicts v ON v.request_id = p.request_id WHERE v.reason IS NULL""",
    "price_orders_rejects": """SELECT o.order_id AS request_id, o.user_id,
               CASE WHEN v.request_id IS NULL THEN 'Order must contain at least one item' ELSE v.reason END AS reason
        FROM x_orders o LEFT JOIN x_verdicts v ON o.order_id = v.request_id
        WHERE v.request_id IS NULL OR v.reason IS NOT NULL""",
    "place_orders_orders": """SELECT request_id, order_id, user_id, order_number, CAST(total_amount AS DOUBLE) AS total_amount,
               order_type, created_at FROM x_placed""",
    "place_orders_lines": """SELECT d.request_id, d.order_id, count(*) AS lines, CAST(sum(p.subtotal) AS DOUBLE) AS subtotal,
               count(*) AS id_span
        FROM x_placed d JOIN x_priced p ON p.request_id = d.request_id GROUP BY ALL""",
    "place_orders_rejects": """SELECT request_id, user_id, reason FROM x_placements WHERE reason IS NOT NULL""",
    "place_orders_events": """SELECT d.order_id AS "orderId", d.order_number AS "orderNumber",
               CAST(d.total_amount AS DOUBLE) AS "totalAmount", d.user_id AS "userId", u.username,
               d.order_type AS "orderType", d.scheduled_at AS "scheduledAt", d.created_at AS "at"
        FROM x_placed d LEFT JOIN x_users u ON u.user_id = d.user_id""",
    "price_orders_verdicts": """SELECT order_id AS request_id FROM x_orders""",
    "apply_order_updates": """SELECT o.order_id, coalesce(s.status, o.status) AS status,
               coalesce(p.payment_status, o.payment_status) AS payment_status
        FROM x_orders o
        LEFT JOIN (SELECT order_id, arg_max(status, seq) AS status FROM x_order_changes
                   WHERE status IN ('ready', 'cancelled', 'completed') GROUP BY order_id) s ON s.order_id = o.order_id
        LEFT JOIN (SELECT order_id, arg_max(payment_status, seq) AS payment_status FROM x_order_changes
                   WHERE payment_status IN ('paid', 'refunded') GROUP BY order_id) p ON p.order_id = o.order_id""",
    "order_update_rejects": """SELECT c.seq, c.order_id,
               CASE WHEN coalesce(c.status, 'lost') = 'lost' AND coalesce(c.payment_status, 'unknown') = 'unknown'
                    THEN 'No valid fields provided for update' ELSE 'Order not found' END AS reason
        FROM x_order_changes c LEFT JOIN x_orders o ON o.order_id = c.order_id
        WHERE o.order_id IS NULL
           OR (coalesce(c.status, 'lost') = 'lost' AND coalesce(c.payment_status, 'unknown') = 'unknown')""",
    "category_changes_applied": """SELECT c.category_id, coalesce(l.new_name, c.category_name) AS category_name,
               coalesce(l.new_active, c.is_active) AS is_active
        FROM x_categories c LEFT JOIN x_category_last l ON l.category_id = c.category_id""",
    "category_cascade": """SELECT m.item_id, m.category_id, coalesce(l.new_active, m.is_active) AS is_active,
               coalesce(l.new_active, m.is_available) AS is_available
        FROM x_menu m LEFT JOIN (SELECT l.* FROM x_category_last l JOIN x_categories c ON c.category_id = l.category_id) l
             ON l.category_id = m.category_id""",
    "category_change_rejects": """SELECT h.seq, h.category_id,
               CASE WHEN h.category_name IS NULL AND h.is_active IS NULL THEN 'No valid fields to update'
                    ELSE 'Category not found' END AS reason
        FROM x_category_changes h LEFT JOIN x_categories c ON c.category_id = h.category_id
        WHERE c.category_id IS NULL OR (h.category_name IS NULL AND h.is_active IS NULL)""",
    "update_items": """SELECT m.item_id,
               CASE WHEN n.item_id IS NULL THEN m.category_id ELSE nullif(n.category_id, 0) END AS category_id,
               coalesce(n.item_name, m.item_name) AS item_name,
               CASE WHEN n.item_id IS NULL THEN m.description ELSE nullif(n.description, '') END AS description,
               CAST(coalesce(n.price, m.price) AS DOUBLE) AS price, m.image_url,
               CASE WHEN n.item_id IS NULL THEN m.is_available ELSE coalesce(n.is_available, false) END AS is_available,
               m.is_active
        FROM x_menu m LEFT JOIN (SELECT * FROM x_item_changes
             QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) = 1) n ON n.item_id = m.item_id""",
    "update_items_rejects": """SELECT seq, item_id, 'Menu item not found' AS reason FROM x_item_changes
        WHERE item_id NOT IN (SELECT item_id FROM x_menu)""",
    "soft_delete_items": """SELECT item_id, is_active AND item_id NOT IN (SELECT item_id FROM x_item_changes) AS is_active,
               is_available FROM x_menu""",
    "insert_users": """WITH s AS (SELECT event_id,
                   CASE WHEN k % 9 = 0 THEN NULL ELSE concat('guest_', user_id * 3 + k) END AS username, k
            FROM x_events WHERE event_type = 'signup'),
        n AS (SELECT * FROM s WHERE username IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY username ORDER BY event_id) = 1)
        SELECT user_id, username, email, full_name, phone, role, is_active FROM x_users UNION ALL
        SELECT (SELECT max(user_id) FROM x_users) + row_number() OVER (ORDER BY event_id), username,
               concat('guest_', event_id, '@example.org'), concat('Guest ', k), NULL, 'customer', true FROM n""",
    "insert_users_rejects": """WITH s AS (
            SELECT event_id, concat('Visitor_', (event_id + k) // 2) AS username,
                   CASE WHEN k % 13 <> 0 THEN concat('box', event_id // 2, '@x.org') END AS email FROM x_events),
        clash AS (SELECT DISTINCT a.event_id AS earlier, b.event_id AS later FROM s a JOIN s b
                  ON a.event_id < b.event_id AND a.username = b.username
                  UNION SELECT a.event_id, b.event_id FROM s a JOIN s b ON a.event_id < b.event_id AND a.email = b.email),
        settled AS (SELECT * FROM (WITH RECURSIVE rounds AS (
            SELECT 0 AS turn, event_id, CASE WHEN event_id IN (SELECT later FROM clash) THEN 'open' ELSE 'in' END AS state
            FROM s
            UNION ALL
            SELECT any_value(w.turn) + 1, w.event_id,
                   CASE WHEN w.state <> 'open' THEN w.state WHEN bool_or(e.state = 'in') THEN 'out'
                        WHEN bool_and(e.state = 'out') THEN 'in' ELSE 'open' END
            FROM rounds w LEFT JOIN clash c ON c.later = w.event_id LEFT JOIN rounds e ON e.event_id = c.earlier
            WHERE EXISTS (SELECT 1 FROM rounds o WHERE o.state = 'open')
            GROUP BY w.event_id, w.state) SELECT * FROM rounds))
        SELECT event_id AS request_id, username, email FROM s
        WHERE event_id IN (SELECT event_id FROM settled WHERE state = 'out')""",
    "insert_items": """SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM x_menu UNION ALL
        SELECT (SELECT max(item_id) FROM x_menu) + row_number() OVER (ORDER BY event_id),
               CASE WHEN k % 6 > 0 THEN k % 6 END, concat('New dish ', k), CASE WHEN k % 3 = 1 THEN 'tasty' END,
               CAST(k + 0.75 AS DOUBLE), CASE WHEN k % 4 <> 0 THEN '/img/new' END,
               k % 5 <> 0 AND k % 2 = 0, true
        FROM x_events WHERE event_type = 'click'""",
    "insert_categories": """SELECT * FROM x_categories UNION ALL
        SELECT CAST((SELECT max(category_id) FROM x_categories) + row_number() OVER (ORDER BY event_id) AS INT), category_name,
               coalesce(is_active, true)
        FROM x_asked_categories WHERE nth = 1 AND NOT stored""",
    "insert_categories_rejects": """SELECT event_id AS request_id, category_name FROM x_asked_categories
        WHERE nth > 1 OR stored""",
    "propagate_deletes_counts": """
        SELECT 'users' AS table_name, count(*) AS rows_left FROM x_users WHERE is_active UNION ALL
        SELECT 'categories', count(*) FROM x_categories WHERE is_active UNION ALL
        SELECT 'menu_items', count(*) FROM x_kept_items UNION ALL
        SELECT 'orders', count(*) FROM x_kept_orders UNION ALL
        SELECT 'order_items', count(*) FROM x_kept_lines UNION ALL
        SELECT 'menu_items without category', count(*) FROM x_kept_items WHERE category_id IS NULL""",
    "propagate_deletes_rejects": """SELECT 'menu_items' AS "table", item_id AS id, 'Item is used by order lines' AS reason
        FROM x_used_items""",
    # Quality
    "constraint_report": _constraints(),
    "total_reconciliation": """SELECT o.order_id, CAST(o.total_amount AS DOUBLE) AS total_amount,
               CAST(coalesce(s.line_total, 0) AS DOUBLE) AS line_total,
               CAST(o.total_amount - coalesce(s.line_total, 0) AS DOUBLE) AS difference
        FROM x_orders o LEFT JOIN (SELECT order_id, sum(subtotal) AS line_total FROM x_items GROUP BY order_id) s
             ON s.order_id = o.order_id WHERE abs(o.total_amount - coalesce(s.line_total, 0)) > 0.005""",
    "line_reconciliation": """SELECT order_id, order_item_id, item_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
               CAST(subtotal AS DOUBLE) AS subtotal, CAST(unit_price * quantity AS DOUBLE) AS expected_subtotal,
               CAST(subtotal - unit_price * quantity AS DOUBLE) AS difference
        FROM x_items WHERE abs(subtotal - unit_price * quantity) > 0.005""",
    "signup_errors": _errors("x_signups", _LIVE_RULES),
    "signup_errors_strict": _errors("x_signups", _STRICT_RULES),
    "signup_valid": f"""SELECT request_id, {_NAME} AS username FROM x_signups WHERE length({_NAME}) >= 3
        AND regexp_matches(email, '{_EMAIL}') AND coalesce(role, 'customer') IN ('customer', 'admin')""",
    "cap_admins_rejects": """SELECT user_id AS request_id,
               'Admin registration failed: Maximum of 2 admin accounts allowed.' AS first_error
        FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS n FROM x_users WHERE role = 'admin') WHERE n > 1""",
    "item_errors": _errors("x_item_requests", _ITEM_RULES),
    "category_errors": _errors("x_item_requests", _CATEGORY_RULES),
    "order_request_errors": """SELECT * FROM (SELECT order_id AS request_id,
               CASE WHEN order_id % 3 <> 0 AND order_id % 4 = 0 THEN 'scheduled' ELSE 'asap' END AS order_type,
               CASE WHEN order_id % 3 <> 0 AND (order_id % 16 = 0 OR order_id % 20 = 0) THEN 'scheduled_at'
                    WHEN order_id % 17 = 0 THEN 'items' WHEN order_id % 10 = 0 THEN 'payment_method'
                    WHEN order_id % 11 = 0 OR order_id % 13 = 0 THEN 'items' END AS field,
               CASE WHEN order_id % 3 <> 0 AND (order_id % 16 = 0 OR order_id % 20 = 0) THEN 'Invalid or past scheduled time.'
                    WHEN order_id % 17 = 0 THEN 'Order must contain at least one item'
                    WHEN order_id % 10 = 0 THEN 'Payment method is required'
                    WHEN order_id % 11 = 0 THEN 'Invalid item data (item ID or quantity missing/invalid).'
                    WHEN order_id % 13 = 0 THEN 'Item quantity must be at least 1' END AS first_error
        FROM x_orders) WHERE field IS NOT NULL""",
    "cart_message_errors": """SELECT event_id, user_id, payload,
               CASE WHEN NOT object THEN 'Invalid cart:add payload' ELSE 'Malformed item data' END AS first_error
        FROM x_cart_checked WHERE NOT object OR id_number IS NULL OR id_number <> floor(id_number)""",
    "status_anomalies": """SELECT * FROM (SELECT order_id, seq, previous, status,
               CASE WHEN status = 'lost' THEN 'unknown status'
                    WHEN previous IN ('completed', 'cancelled') AND status <> previous THEN 'left an end state'
                    WHEN status IN ('pending', 'confirmed', 'preparing', 'ready', 'completed')
                     AND previous IN ('pending', 'confirmed', 'preparing', 'ready', 'completed')
                     AND seq // 100000000 < previous_seq // 100000000 THEN 'step back' END AS anomaly
            FROM (SELECT *, lag(status) OVER w AS previous, lag(seq) OVER w AS previous_seq FROM x_history
                  WINDOW w AS (PARTITION BY order_id ORDER BY "at", seq)))
        WHERE anomaly IS NOT NULL""",
}


def _cart(source: str) -> str:
    """Cart lines by windows: cut each item's events at its removals, then at its last set."""
    return f"""SELECT user_id, item_id, CAST(base + adds AS INT) AS quantity FROM (
        SELECT user_id, item_id, first_add, coalesce(max(quantity) FILTER (WHERE event_id = last_set), 0) AS base,
               count(*) FILTER (WHERE action = 'add' AND event_id > coalesce(last_set, -1)) AS adds
        FROM (SELECT *, max(event_id) FILTER (WHERE action = 'set' AND event_id > first_add)
                        OVER (PARTITION BY user_id, item_id) AS last_set
              FROM (SELECT *, min(event_id) FILTER (WHERE action = 'add') OVER (PARTITION BY user_id, item_id) AS first_add
                    FROM (SELECT *, max(CASE WHEN action = 'remove' OR (action = 'set' AND quantity <= 0) THEN event_id END)
                                    OVER (PARTITION BY user_id, item_id) AS removed
                          FROM (SELECT *, max(CASE WHEN action = 'clear' THEN event_id END) OVER (PARTITION BY user_id) AS cleared
                                FROM ({source}))
                          WHERE action <> 'clear' AND event_id > coalesce(cleared, -1))
                    WHERE event_id > coalesce(removed, -1)))
        GROUP BY user_id, item_id, first_add) WHERE first_add IS NOT NULL"""


def _menu_view(style: str) -> str:
    if style == "customer":
        resets = "(kind = 'error' OR kind = 'purchase')"
        adds, changes = "(kind = 'click' AND NOT has_active)", "kind IN ('view', 'signup')"
    else:
        resets, adds, changes = "kind = 'error'", "kind = 'click'", "kind IN ('view', 'purchase', 'signup')"
    lives = f"""WITH f AS (SELECT *, max(CASE WHEN {resets} THEN seq END) OVER (PARTITION BY item_id) AS reset FROM x_menu_changes),
        g AS (SELECT f.*, m.item_id IS NOT NULL AND reset IS NULL AS known, {adds} AS adds, {changes} AS changes,
                     min(CASE WHEN {adds} AND seq > coalesce(reset, -1) THEN seq END) OVER (PARTITION BY f.item_id) AS born
              FROM f LEFT JOIN x_menu m ON m.item_id = f.item_id),
        h AS (SELECT * FROM g WHERE (adds OR changes) AND seq > coalesce(reset, -1) AND (known OR seq >= born)),
        kept AS (SELECT * FROM x_menu WHERE item_id NOT IN (SELECT item_id FROM f WHERE reset IS NOT NULL))"""
    if style == "customer":
        return f"""{lives},
        v AS (SELECT item_id, bool_or(has_name) AS hn, last(new_name ORDER BY seq) FILTER (WHERE has_name) AS nn,
                     bool_or(has_price) AS hp, last(new_price ORDER BY seq) FILTER (WHERE has_price) AS np,
                     bool_or(has_text) AS ht, last(new_text ORDER BY seq) FILTER (WHERE has_text) AS nt,
                     bool_or(has_available) AS ha, last(new_available ORDER BY seq) FILTER (WHERE has_available) AS na,
                     bool_or(has_active) AS hc, last(new_active ORDER BY seq) FILTER (WHERE has_active) AS nc
              FROM h GROUP BY item_id)
        SELECT coalesce(k.item_id, v.item_id) AS item_id, CASE WHEN hn THEN nn ELSE item_name END AS item_name,
               CASE WHEN ht THEN nt ELSE description END AS description,
               CAST(CASE WHEN hp THEN np ELSE price END AS DOUBLE) AS price,
               CASE WHEN ha THEN na ELSE is_available END AS is_available,
               CASE WHEN hc THEN nc ELSE is_active END AS is_active
        FROM kept k FULL JOIN v ON v.item_id = k.item_id"""
    return f"""{lives},
        w AS (SELECT * FROM h WHERE changes OR (NOT known AND seq = born)
              QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) = 1)
        SELECT item_id, item_name, description, CAST(price AS DOUBLE) AS price, is_available, is_active
        FROM kept WHERE item_id NOT IN (SELECT item_id FROM w) UNION ALL
        SELECT item_id, CASE WHEN has_name THEN new_name END, CASE WHEN has_text THEN new_text END,
               CAST(CASE WHEN has_price THEN new_price END AS DOUBLE), CASE WHEN has_available THEN new_available END,
               CASE WHEN has_active THEN new_active END FROM w"""


_CART_ACTIVITY = """SELECT 'cart_add' AS type, c.user_id, u.username, CAST(c.id_number AS BIGINT) AS item_id,
               CAST(coalesce(c.quantity, 1) AS INT) AS quantity, c.ts AS "at"
        FROM x_cart_checked c JOIN x_users u ON u.user_id = c.user_id WHERE c.id_number = floor(c.id_number)"""

BODIES |= {
    # Logs, audit rows and feeds
    "access_log_rows": """SELECT event_id, CASE WHEN status >= 400 THEN 'ERROR' ELSE 'INFO' END AS level, method, path,
               CAST(status AS INT) AS status, duration_ms FROM x_requests""",
    "audit_changes": """SELECT order_id AS log_id, user_id, order_id AS entity_id, created_at, field, old_value, new_value FROM (
            SELECT order_id, user_id, created_at, 'status' AS field, 'pending' AS old_value, status AS new_value FROM x_orders
            UNION ALL SELECT order_id, user_id, created_at, 'payment_status', 'pending', payment_status FROM x_orders
            UNION ALL SELECT order_id, user_id, created_at, 'order_type', order_type, NULL FROM x_orders
            UNION ALL SELECT order_id, user_id, created_at, 'note', NULL, special_instructions FROM x_orders)
        WHERE old_value IS DISTINCT FROM new_value""",
    "cart_activity": _CART_ACTIVITY,
    "cart_activity_stream": _CART_ACTIVITY,
    "cart_state_batch": _cart("SELECT * FROM x_cart_all"),
    "cart_state_stream": _cart("SELECT * FROM x_cart WHERE ts <= (SELECT until FROM x_closed)"),
    "cart_totals": f"""SELECT l.user_id, CAST(sum(m.price * l.quantity) AS DOUBLE) AS cart_total
        FROM ({_cart("SELECT * FROM x_cart_all")}) l JOIN x_menu m ON m.item_id = l.item_id GROUP BY l.user_id""",
    "cart_line_counts": f"""SELECT user_id, count(*) AS line_count FROM ({_cart("SELECT * FROM x_cart_all")}) GROUP BY user_id""",
    "new_order_stream": "SELECT DISTINCT user_id * 100 + k AS order_id FROM x_events WHERE event_type = 'purchase'",
    "appended_lines": """SELECT CAST(l_shipdate AS DATE) AS order_date, count(*) AS lines,
               CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS units FROM lineitem GROUP BY 1""",
    "compacted_changes": """SELECT order_id, status, payment_status, seq FROM x_order_changes
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) = 1""",
    "order_feed_stream": """SELECT o.order_id, o.order_number,
               CASE WHEN c.seq IS NULL THEN o.status ELSE c.status END AS status,
               CASE WHEN c.seq IS NULL THEN o.payment_status ELSE c.payment_status END AS payment_status, o.created_at
        FROM x_orders o LEFT JOIN (SELECT * FROM x_order_changes
             QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) = 1) c ON c.order_id = o.order_id""",
    "room_sink": """WITH r AS (
            SELECT CASE event_type WHEN 'purchase' THEN 'order:new' WHEN 'click' THEN 'cart:activity'
                        WHEN 'view' THEN 'menu:item:update' WHEN 'signup' THEN 'category:update' ELSE 'order:update' END AS event,
                   'admins' AS audience, 'admins' AS room FROM x_events
            UNION ALL SELECT 'menu:item:update', 'customers', 'customers' FROM x_events WHERE event_type = 'view'
            UNION ALL SELECT 'menu:full:refresh', 'customers', 'customers' FROM x_events WHERE event_type = 'signup' AND k % 3 = 0
            UNION ALL SELECT 'order:update', 'user', concat('user:', user_id) FROM x_events WHERE event_type = 'error' AND k % 3 = 0)
        SELECT audience, room, event, count(*) AS events FROM r GROUP BY ALL""",
    "routed_events": """WITH e AS (SELECT event_id, user_id, k % 3 = 0 AS status_sent,
                   CASE event_type WHEN 'purchase' THEN 'order:new' WHEN 'click' THEN 'cart:activity'
                        WHEN 'view' THEN 'menu:item:update' WHEN 'signup' THEN 'category:update' ELSE 'order:update' END AS event
            FROM x_events)
        SELECT *, 'admins' AS room FROM e UNION ALL
        SELECT *, 'customers' FROM e WHERE event = 'menu:item:update' UNION ALL
        SELECT event_id, user_id, status_sent, 'menu:full:refresh', 'customers' FROM e
        WHERE event = 'category:update' AND status_sent UNION ALL
        SELECT *, concat('user:', user_id) FROM e WHERE event = 'order:update' AND status_sent""",
    "new_order_feed": """SELECT user_id * 100 + k AS order_id, concat('ORD', event_id) AS order_number,
               CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS total_amount, user_id, CAST(NULL AS VARCHAR) AS username,
               'asap' AS order_type, CAST(NULL AS TIMESTAMP) AS scheduled_at, ts AS "at"
        FROM x_events WHERE event_type = 'purchase'
        QUALIFY row_number() OVER (PARTITION BY user_id * 100 + k ORDER BY ts) = 1""",
    "menu_view_customer": _menu_view("customer"),
    "menu_view_stream": _menu_view("customer"),
    "menu_view_admin": _menu_view("admin"),
    "category_view": """WITH e AS (SELECT CAST(k % 60 AS INT) AS category_id, event_id AS seq, event_type = 'signup' AS adds,
                   CASE WHEN k % 2 = 0 THEN k % 4 = 0 END AS is_active
            FROM x_events WHERE event_type IN ('signup', 'purchase')),
        f AS (SELECT e.*, c.category_id IS NOT NULL AS known, min(CASE WHEN adds THEN seq END) OVER (PARTITION BY e.category_id) AS born
              FROM e LEFT JOIN x_categories c ON c.category_id = e.category_id),
        w AS (SELECT * FROM f WHERE (known AND NOT adds) OR (NOT known AND (seq = born OR (NOT adds AND seq > born)))
              QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY seq DESC) = 1)
        SELECT * FROM x_categories WHERE category_id NOT IN (SELECT category_id FROM w) UNION ALL
        SELECT category_id, concat('Category ', seq), is_active FROM w""",
    "order_feed_admin": """SELECT o.order_id, CASE WHEN c.seq IS NULL THEN o.order_number ELSE concat('UPD', c.seq) END AS order_number,
               CAST(coalesce(c.seq, o.total_amount) AS DOUBLE) AS total_amount,
               CASE WHEN c.seq IS NULL THEN o.status ELSE c.status END AS status,
               CASE WHEN c.seq IS NULL THEN o.payment_status ELSE c.payment_status END AS payment_status, o.created_at
        FROM x_orders o LEFT JOIN (SELECT * FROM x_order_changes
             QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) = 1) c ON c.order_id = o.order_id""",
    "order_feed_customer": """SELECT o.order_id, o.order_number, CAST(o.total_amount AS DOUBLE) AS total_amount,
               CASE WHEN c.seq IS NULL THEN o.status ELSE c.status END AS status,
               CASE WHEN c.seq IS NULL THEN o.payment_status ELSE c.payment_status END AS payment_status, o.created_at
        FROM x_orders o LEFT JOIN (SELECT * FROM x_order_changes
             QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) = 1) c ON c.order_id = o.order_id""",
    "rate_violations_batch": "SELECT * FROM x_violations",
    "rate_violations_stream": "SELECT * FROM x_violations WHERE window_end <= (SELECT until FROM x_closed)",
    "rate_violations_daily": """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
               time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, client, count(*) AS requests
        FROM x_requests GROUP BY ALL HAVING count(*) > 3""",
    "client_windows": """SELECT s.start AS window_start, s.start + INTERVAL 2 DAY AS window_end, s.client, count(*) AS requests
        FROM (WITH RECURSIVE s AS (
                SELECT client, min(ts) AS start FROM x_requests GROUP BY client
                UNION ALL
                SELECT s.client, min(r.ts) FROM s JOIN x_requests r ON r.client = s.client AND r.ts >= s.start + INTERVAL 2 DAY
                GROUP BY s.client, s.start) SELECT * FROM s) s
        JOIN x_requests r ON r.client = s.client AND r.ts >= s.start AND r.ts < s.start + INTERVAL 2 DAY
        GROUP BY s.client, s.start""",
    "limit_violations": """SELECT s.start AS window_start, s.start + s.step AS window_end, s.client, count(*) AS requests, s.limit_name
        FROM (WITH RECURSIVE s AS (
                SELECT limit_name, most, step, client, min(ts) AS start FROM x_limited GROUP BY ALL
                UNION ALL
                SELECT s.limit_name, s.most, s.step, s.client, min(r.ts)
                FROM s JOIN x_limited r ON r.client = s.client AND r.limit_name = s.limit_name AND r.ts >= s.start + s.step
                GROUP BY s.limit_name, s.most, s.step, s.client, s.start) SELECT * FROM s) s
        JOIN x_limited r ON r.client = s.client AND r.limit_name = s.limit_name
                        AND r.ts >= s.start AND r.ts < s.start + s.step
        GROUP BY s.client, s.start, s.step, s.limit_name, s.most HAVING count(*) > s.most""",
    "request_metrics_batch": "SELECT * FROM x_metrics",
    "request_metrics_stream": """SELECT * FROM x_metrics
        WHERE window_start + INTERVAL 15 MINUTE <= (SELECT until FROM x_closed)""",
    "connection_sessions": "SELECT * EXCLUDE (next_ts) FROM x_sessions",
    "connection_stream": """SELECT * EXCLUDE (next_ts) FROM x_sessions
        WHERE next_ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM x_connections)""",
    "activity_sessions_stream": """WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS nr FROM s)
        SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 2 HOUR AS ended_at, count(*) AS events
        FROM n GROUP BY user_id, nr HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT until FROM x_closed)""",
}


def _audited(entity: str, key: str, old: str, new: str, fields: str) -> str:
    """One row per field of a row of ``old`` that ``new`` has otherwise."""
    parts = [
        f"""SELECT 'update' AS action, CAST(o.{key} AS BIGINT) AS entity_id, '{f}' AS field,
                   CAST(o.{f} AS VARCHAR) AS old_value, CAST(n.{f} AS VARCHAR) AS new_value
            FROM ({old}) o JOIN ({new}) n ON n.{key} = o.{key} WHERE o.{f} IS DISTINCT FROM n.{f}"""
        for f in fields.split()
    ]
    return " UNION ALL ".join(parts)


_ITEM_FIELDS = "category_id item_name description price is_available"
_TWO_DIGITS = "SELECT * REPLACE (CAST(price AS DECIMAL(10,2)) AS price) FROM"
BODIES |= {
    "audit_of_order_updates": _audited(
        "order", "order_id", "SELECT * FROM x_orders", BODIES["apply_order_updates"], "status payment_status"
    ),
    "audit_of_item_updates": _audited(
        "menu_item", "item_id", f"{_TWO_DIGITS} x_menu", f"{_TWO_DIGITS} ({BODIES['update_items']})", _ITEM_FIELDS
    ),
    "audit_of_category_changes": _audited(
        "menu_item", "item_id", "SELECT * FROM x_menu", BODIES["category_cascade"], "is_active is_available"
    )
    + " UNION ALL "
    + _audited(
        "category", "category_id", "SELECT * FROM x_categories", BODIES["category_changes_applied"], "category_name is_active"
    ),
    "request_metrics_daily": """SELECT date_trunc('day', ts) AS window_start, method, count(*) AS requests,
               count(*) FILTER (WHERE status >= 400) AS errors,
               CAST(sum(duration_ms) AS DOUBLE) / count(*) AS mean_ms, quantile_disc(duration_ms, 0.95) AS p95_ms
        FROM x_requests GROUP BY ALL""",
}

# Queries that give the rows of another one in another way.
BODIES |= {
    "category_view_stream": BODIES["category_view"],
    "cart_state_keyed": BODIES["cart_state_stream"],
    "connection_stream_keyed": BODIES["connection_stream"],
}

_CHANGED_ORDERS = f"""(SELECT o.order_id, o.user_id, o.total_amount, o.created_at, a.status
                       FROM x_orders o JOIN ({BODIES["apply_order_updates"]}) a ON a.order_id = o.order_id)"""
BODIES |= {
    "daily_sales_kept": f"""SELECT CAST(created_at AS DATE) AS sale_date, {_SALES} FROM {_CHANGED_ORDERS}
        WHERE status = 'completed' AND coalesce(user_id NOT IN (SELECT user_id FROM x_gone_users), true) GROUP BY 1""",
    "top_selling_kept": f"""SELECT m.item_id, m.item_name, CAST(sum(i.quantity) AS BIGINT) AS total_quantity_sold,
               CAST(sum(i.subtotal) AS DOUBLE) AS total_revenue, count(DISTINCT i.order_id) AS times_ordered
        FROM x_items i JOIN x_menu m ON m.item_id = i.item_id
        WHERE NOT EXISTS (SELECT 1 FROM {_CHANGED_ORDERS} o WHERE o.order_id = i.order_id
                          AND (o.status = 'cancelled' OR o.user_id IN (SELECT user_id FROM x_gone_users)))
        GROUP BY m.item_id, m.item_name ORDER BY total_quantity_sold DESC, m.item_id LIMIT 10""",
}


def oracle(name: str) -> str:
    """The query text with the mapping views it uses, each view defined once."""
    body = BODIES[name]
    needed: set[str] = set()

    def collect(text: str) -> None:
        for view, definition in VIEWS.items():
            if view in text and view not in needed:
                needed.add(view)
                collect(definition)

    collect(body)
    ctes = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in VIEWS if view in needed)
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[5:]}"
    return f"WITH {ctes}\n{body}"


ORACLES = {name: oracle(name) for name in BODIES}
