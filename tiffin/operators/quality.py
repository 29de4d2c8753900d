"""Row checks and reports.

A check adds ``errors``, an array of (field, message) with every broken rule.
``split`` turns it into valid and rejected rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.functions import domains
from tiffin.functions.text import clean_email, is_email, is_phone, is_username, name_key, trimmed
from tiffin.operators.sequences import previous_in_order

SAYS = domains.MESSAGES
Rule = tuple[str, Column, str]  # field, condition of a broken row, message


class Split(NamedTuple):
    valid: DataFrame
    rejected: DataFrame


def with_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    errors = [
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(text).alias("message")))
        for field, broken, text in rules
    ]
    return df.withColumn("errors", F.array_compact(F.array(*errors)))


def split(checked: DataFrame) -> Split:
    """Valid rows as the check cleaned them; rejected rows with all errors and the first message."""
    return Split(
        checked.filter(F.size("errors") == 0).drop("errors"),
        checked.filter(F.size("errors") > 0).withColumn("first_error", F.col("errors")[0]["message"]),
    )


def _length(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def _cleaned(df: DataFrame, *names: str) -> DataFrame:
    """The rows with trimmed texts: what is checked is what is stored."""
    return df.withColumns({name: trimmed(F.col(name)) for name in names})


def _not(condition: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def check_signups(df: DataFrame, profile: str = "live") -> DataFrame:
    """Sign-up requests; ``profile="strict"`` applies the declared stricter rules.

    User names come out trimmed; with the strict rules, all texts do, and e-mail addresses in lower case.
    """
    username, email = F.col("username"), F.col("email")
    df = _cleaned(df, "username")
    if profile == "live":
        rules = [
            ("username", _length(username) < 3, SAYS["username_short"]),
            ("email", _not(is_email(email)), SAYS["email"]),
            ("role", ~F.col("role").isin(domains.ROLES), SAYS["role"]),
        ]
    else:
        df = _cleaned(df, "full_name", "phone").withColumn("email", clean_email(email))
        rules = [
            ("username", ~_length(username).between(3, 20), SAYS["username_length"]),
            (
                "username",
                _not(is_username(username)),
                SAYS["username_charset"],
            ),
            ("email", _not(is_email(email)), SAYS["email_format"]),
            ("full_name", ~_length(F.col("full_name")).between(2, 100), SAYS["full_name"]),
            ("phone", ~is_phone(F.col("phone")), SAYS["phone"]),
        ]
    return with_errors(df, rules)


def check_items(df: DataFrame) -> DataFrame:
    """Item requests with text fields as sent; name, description and image come out trimmed."""
    df = _cleaned(df, *[c for c in ("item_name", "description", "image_url") if c in df.columns])
    name, price = F.col("item_name"), F.col("price").cast("string")
    number = F.trim(price).try_cast("double")
    category = F.nullif(F.trim(F.col("category_id").cast("string")), F.lit(""))
    rules = [
        ("item_name", _length(name) == 0, SAYS["item_name"]),
        ("item_name", ~_length(name).between(1, 100), SAYS["item_name_length"]),
        ("price", F.coalesce(price, F.lit("")) == "", SAYS["price"]),
        ("price", number.isNull() | F.isnan(number) | (number <= 0), SAYS["price_number"]),
        ("category_id", category.isNotNull() & category.try_cast("double").isNull(), SAYS["category_id"]),
        ("description", _length(F.col("description")) > 500, SAYS["description"]),
    ]
    if df.schema["is_available"].dataType.typeName() != "boolean":
        flag = F.col("is_available").cast("string")
        rules.append(("is_available", ~flag.isin("true", "false"), SAYS["is_available"]))
    return with_errors(df, rules)


def check_categories(df: DataFrame) -> DataFrame:
    """Category requests; the name comes out trimmed."""
    df = _cleaned(df, "category_name")
    flag = F.col("is_active").cast("string")
    rules = [
        ("category_name", ~_length(F.col("category_name")).between(1, 100), SAYS["category_name"]),
        ("is_active", ~flag.isin("true", "false", "1", "0"), SAYS["is_active"]),
    ]
    return with_errors(df, rules)


def check_order_requests(df: DataFrame) -> DataFrame:
    """Order requests, tested at their own time ``ts``.

    The order type is normalised to asap or scheduled. Only the first broken rule
    is reported: schedule, then lines, then payment, then the lines in detail.
    """
    due = F.col("scheduled_at").try_cast("timestamp")
    scheduled = F.coalesce(F.col("order_type") == "scheduled", F.lit(False))

    def broken(item):
        return item["item_id"].isNull() | item["quantity"].isNull() | (item["quantity"] < 1)

    first = F.get(F.filter("items", broken), F.lit(0))
    steps = [
        (
            "scheduled_at",
            scheduled & (F.coalesce("scheduled_at", F.lit("")) == ""),
            SAYS["schedule_missing"],
        ),
        ("scheduled_at", scheduled & (due.isNull() | (due <= F.col("ts"))), SAYS["schedule_past"]),
        ("items", F.coalesce(F.size("items"), F.lit(0)) <= 0, SAYS["no_items"]),
        ("payment_method", F.coalesce("payment_method", F.lit("")) == "", SAYS["payment_method"]),
        (
            "items",
            first.isNotNull() & (first["item_id"].isNull() | first["quantity"].isNull()),
            SAYS["item_data"],
        ),
        ("items", first["quantity"] < 1, SAYS["item_quantity"]),
    ]
    all_errors = with_errors(df, steps).withColumn("errors", F.slice("errors", 1, 1))
    return all_errors.withColumns(
        {
            "order_type": F.when(scheduled, "scheduled").otherwise("asap"),
            "scheduled_at": F.when(scheduled, F.date_trunc("second", due)),
        }
    )


def check_cart_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``cart:add`` messages: an object with an item that has a whole number as id; quantity defaults to 1.

    A number is whole by its value (``2.0`` is); a quoted number is text.
    """
    document = F.try_parse_json(payload)

    def whole(path):
        kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
        number = F.try_variant_get(document, path, "double")
        is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.when(is_number & (number == F.floor(number)), F.try_variant_get(document, path, "bigint"))

    is_object = F.coalesce(F.schema_of_variant(document).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    item_id = whole("$.item.item_id")
    rules = [
        ("payload", ~is_object, SAYS["cart_payload"]),
        ("item_id", is_object & item_id.isNull(), SAYS["cart_item"]),
    ]
    quantity = F.coalesce(whole("$.item.quantity").try_cast("int"), F.lit(1))
    return with_errors(df, rules).withColumns({"item_id": item_id, "quantity": quantity})


def cap_admins(users: DataFrame, signups: DataFrame, cap: int = domains.MAX_ADMINS) -> Split:
    """Admin sign-ups in order of arrival until the cap; other sign-ups always pass."""
    existing = users.filter("role = 'admin'").limit(cap).count()
    free = max(cap - existing, 0)
    winners = signups.filter("role = 'admin'").orderBy("ts", "request_id").limit(free).select("request_id")
    late = signups.filter("role = 'admin'").join(F.broadcast(winners), "request_id", "left_anti")
    valid = signups.join(F.broadcast(winners.withColumn("_won", F.lit(True))), "request_id", "left").filter(
        (F.coalesce("role", F.lit("customer")) != "admin") | F.col("_won")
    )
    message = SAYS["admin_cap"] % cap
    return Split(valid.drop("_won"), late.withColumn("first_error", F.lit(message)))


# Status history -------------------------------------------------------------


def status_anomalies(history: DataFrame) -> DataFrame:
    """Unknown states, steps back, and steps out of an end state.

    The application accepts any known state after any other, so this only reports.
    ``history``: order_id, at, seq, status.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in domains.ORDER_STATUSES[:5]]), F.col("status"))
    place_before = F.array_position(F.array(*[F.lit(s) for s in domains.ORDER_STATUSES[:5]]), F.col("previous"))
    anomaly = (
        F.when(~F.col("status").isin(domains.ORDER_STATUSES), "unknown status")
        .when(
            F.col("previous").isin("completed", "cancelled") & (F.col("status") != F.col("previous")),
            "left an end state",
        )
        .when((place > 0) & (place_before > 0) & (place < place_before), "step back")
    )
    steps = previous_in_order(history, "order_id", ["at", "seq"], "status", "previous")
    return steps.withColumn("anomaly", anomaly).filter("anomaly IS NOT NULL")


# Declared constraints -------------------------------------------------------

# The declared constraints.
NOT_NULL = {
    "users": ["username", "email", "full_name", "role"],
    "categories": ["category_name"],
    "menu_items": ["item_name", "price"],
    "orders": ["user_id", "order_number", "total_amount", "payment_method", "payment_status", "status"],
    "order_items": ["order_id", "item_id", "quantity", "unit_price", "subtotal"],
    "audit_logs": ["action"],
}
UNIQUE = {
    "users": ["user_id", "username", "email"],
    "categories": ["category_id", "category_name"],
    "menu_items": ["item_id"],
    "orders": ["order_id", "order_number"],
    "order_items": ["order_item_id"],
    "audit_logs": ["log_id"],
}
FOREIGN_KEYS = [
    ("menu_items", "category_id", "categories"),
    ("orders", "user_id", "users"),
    ("order_items", "order_id", "orders"),
    ("order_items", "item_id", "menu_items"),
    ("audit_logs", "user_id", "users"),
]
CHECKS = {
    "menu_items": {"price": "price < 0"},
    "orders": {"total_amount": "total_amount <= 0"},
    "order_items": {"quantity": "quantity <= 0", "unit_price": "unit_price <= 0", "subtotal": "subtotal <= 0"},
}
ENUMS = {
    "users": {"role": domains.ROLES},
    "orders": {
        "status": domains.ORDER_STATUSES,
        "payment_status": domains.PAYMENT_STATUSES,
        "order_type": domains.ORDER_TYPES,
    },
}
COLLATED = {"username", "email", "category_name", "order_number"}


def _row_rules(table: str, columns: list[str]) -> dict[str, Column]:
    rules = {f"not null {c}": F.col(c).isNull() for c in NOT_NULL.get(table, [])}
    rules |= {f"check {c}": F.expr(text) for c, text in CHECKS.get(table, {}).items()}
    rules |= {f"enum {c}": ~F.col(c).isin(values) for c, values in ENUMS.get(table, {}).items()}
    rules |= {f"length {c}": F.length(c) > n for c, n in domains.TEXT_LENGTHS.get(table, {}).items()}
    return {name: rule for name, rule in rules.items() if name.split(" ")[-1] in columns}


def _entries(df: DataFrame, entries: list[Column]) -> DataFrame:
    """The entries of every row, NULL ones left out."""
    return df.select(F.inline(F.array_compact(F.array(*entries))))


def _numbers(model: Mapping[str, DataFrame], rules: list[tuple]) -> DataFrame:
    """(owner, violations) of the row rules, unique numbers and foreign keys.

    Every table is read once. A row gives an entry per key it has or refers to, under the table that the key is of, and one
    per row rule it breaks. All entries are counted by owner and key in one shuffle, after partial counts, so a
    busy key is one row per task: a key that occurs more than once in its own table is not unique, and all that refer to one
    that doesn't occur there are without parent.
    """
    parents = {table: n for n, table in enumerate(model)}
    links = [rule for rule in rules if rule[2] == "foreign key"]
    tables = []
    for table, df in model.items():
        entries = []

        def entry(group: int, number: Column, role: int, when: Column) -> Column:
            return F.when(
                when, F.struct(F.lit(group).alias("owner"), number.cast("bigint").alias("number"), F.lit(role).alias("role"))
            )

        for place, (of, name, kind, column) in enumerate(rules):
            if of != table:
                continue
            if kind == "unique" and column not in COLLATED:
                entries.append(entry(parents[table], F.col(column), 0, F.col(column).isNotNull()))
            elif kind == "foreign key":
                parent = next(p for t, c, p in FOREIGN_KEYS if (t, c) == (table, column))
                role = links.index((of, name, kind, column)) + 1
                entries.append(entry(parents[parent], F.col(column), role, F.col(column).isNotNull()))
            elif kind == "row":
                broken = F.coalesce(_row_rules(table, df.columns)[name], F.lit(False))
                entries.append(entry(len(model) + place, F.lit(None), 0, broken))
        tables.append(_entries(df, entries))
    counted = reduce(DataFrame.unionByName, tables).groupBy("owner", "number").agg(
        F.count_if(F.col("role") == 0).alias("own"),
        *[F.count_if(F.col("role") == n + 1).alias(f"link{n}") for n in range(len(links))],
    )
    orphans = [F.sum(F.when(F.col("own") == 0, F.col(f"link{n}"))) for n in range(len(links))]
    beyond = F.sum(F.when(F.col("own") > 1, F.col("own") - 1))
    broken = F.sum(F.when(F.col("number").isNull(), F.col("own")))
    return counted.groupBy("owner").agg(F.array(broken, beyond, *orphans).alias("counts"))


def _names(model: Mapping[str, DataFrame], rules: list[tuple]) -> DataFrame:
    """(place, violations) of the unique names: rows beyond the first of each. Tables with names are read once more."""
    tables = []
    for table, df in model.items():
        own = [
            (place, column)
            for place, (of, _, kind, column) in enumerate(rules)
            if of == table and kind == "unique" and column in COLLATED
        ]
        entries = [
            F.when(F.col(c).isNotNull(), F.struct(F.lit(place).alias("place"), name_key(F.col(c)).alias("name")))
            for place, c in own
        ]
        if entries:
            tables.append(_entries(df, entries))
    counted = reduce(DataFrame.unionByName, tables).groupBy("place", "name").agg(F.count("*").alias("own"))
    return counted.groupBy("place").agg(F.sum(F.col("own") - 1).alias("beyond"))


def constraint_report(model: Mapping[str, DataFrame]) -> DataFrame:
    """Number of violations of every declared constraint: rows that break a rule, rows beyond the first of a key or name, and
    rows without parent. One shuffle counts all keys, one all names; the rest is a row per rule."""
    model = dict(model)
    rules = []  # table, rule, kind, column
    for table, df in model.items():
        rules += [(table, name, "row", None) for name in _row_rules(table, df.columns)]
        rules += [(table, f"unique {c}", "unique", c) for c in UNIQUE[table]]
    links = [(t, f"foreign key {c}", "foreign key", c) for t, c, p in FOREIGN_KEYS if t in model and p in model]
    rules += links
    parents = {table: n for n, table in enumerate(model)}
    listed = []
    for place, (table, name, kind, column) in enumerate(rules):
        if kind == "row":
            listed.append((table, name, place, len(model) + place, 0))
        elif kind == "unique":
            listed.append((table, name, place, None if column in COLLATED else parents[table], 1))
        else:
            parent = next(p for t, c, p in FOREIGN_KEYS if (t, c) == (table, column))
            listed.append((table, name, place, parents[parent], 2 + links.index((table, name, kind, column))))
    spark = next(iter(model.values())).sparkSession
    known = spark.createDataFrame(listed, "table_name STRING, rule STRING, place INT, owner INT, at INT")
    # One row per rule, group or name rule on each side.
    found = known.join(F.broadcast(_numbers(model, rules)), "owner", "left")
    found = found.join(F.broadcast(_names(model, rules)), "place", "left")
    violations = F.coalesce(F.col("counts")[F.col("at")], F.col("beyond"), F.lit(0))
    return found.select("table_name", "rule", violations.cast("bigint").alias("violations"))


def constraint_quarantine(table: str, df: DataFrame) -> Split:
    """Rows that keep all row rules of their table, and the rows that break some."""
    rules = [
        (name.split(" ")[-1], broken, name) for name, broken in _row_rules(table, df.columns).items()
    ]
    return split(with_errors(df, rules))


# Money ------------------------------------------------------------------------

TOLERANCE = 0.005


def total_reconciliation(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders whose total is not the sum of their lines, which is 0 without lines."""
    sums = lines.groupBy("order_id").agg(F.sum("subtotal").alias("line_total"))
    gap = F.col("total_amount") - F.col("line_total")
    return (
        orders.select("order_id", "total_amount")
        .join(sums, "order_id", "left")
        .withColumn("line_total", F.coalesce("line_total", F.lit(0)))
        .withColumn("difference", gap)
        .filter(F.abs("difference") > TOLERANCE)
    )


def line_reconciliation(lines: DataFrame) -> DataFrame:
    """Lines whose subtotal is not unit price times quantity."""
    expected = (F.col("unit_price") * F.col("quantity")).cast("decimal(22,2)")
    return lines.select(
        "order_id",
        "order_item_id",
        "item_id",
        "quantity",
        "unit_price",
        "subtotal",
        expected.alias("expected_subtotal"),
        (F.col("subtotal") - expected).alias("difference"),
    ).filter(F.abs("difference") > TOLERANCE)
