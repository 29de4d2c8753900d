"""Folds of event feeds against plain row-by-row loops over random events."""

import random
from datetime import timedelta
from decimal import Decimal as D

import pandas as pd
import pytest

from tests.conftest import NOW, rows_of
from tiffin.sources import store
from tiffin.sources.events import drain, read_events, write_by_room
from tiffin.sources.schemas import MESSAGES
from tiffin.streaming import carts, connections, feeds, ordered, traffic, views

MENU = "item_id BIGINT, item_name STRING, price DECIMAL(10,2), is_active BOOLEAN"
STATE = [(1, "one", D("1.00"), True), (2, "two", D("2.00"), False), (3, None, None, True)]
FIELDS = ["item_name", "price", "is_active"]


def menu_events(n, seed):
    rng = random.Random(seed)
    events = []
    for seq in range(n):
        payload = {}
        if rng.random() < 0.7:
            payload["item_name"] = rng.choice(["x", "y", None])
        if rng.random() < 0.4:
            payload["price"] = rng.choice(["3.50", "4.00"])
        if rng.random() < 0.4:
            payload["is_active"] = rng.choice(["0", "1", "true", "false"])
        # several events share a time, so seq decides
        events.append((rng.choice(["add", "update", "update", "delete"]), rng.randint(1, 6), payload, NOW + timedelta(seconds=seq // 3), seq))
    rng.shuffle(events)
    return events


def typed(field, value):
    if value is None:
        return None
    return {"item_name": str, "price": D, "is_active": lambda v: v in ("1", "true")}[field](value)


def expected_menu(events, style):
    rows = {r[0]: dict(zip(FIELDS, r[1:])) for r in STATE}
    for op, item, payload, _, _ in sorted(events, key=lambda e: (e[3], e[4])):
        values = {f: typed(f, v) for f, v in payload.items()}
        off = style == "customer" and payload.get("is_active") in ("0", "false")
        if op == "delete" or (op == "update" and off):
            rows.pop(item, None)
        elif op == "add" and not off:
            if style == "customer":
                rows[item] = {**rows.get(item, {}), **values}
            else:
                rows.setdefault(item, values)
        elif op == "update" and item in rows:
            rows[item] = {**rows[item], **values} if style == "customer" else values
    return sorted((item, *[row.get(f) for f in FIELDS]) for item, row in rows.items())


@pytest.mark.parametrize("style", views.STYLES)
@pytest.mark.parametrize("seed", range(4))
def test_menu_view(spark, style, seed):
    events = menu_events(30, seed)
    got = views.merge_menu_events(
        spark.createDataFrame(STATE, MENU), spark.createDataFrame(events, MESSAGES["menu_change"]), style
    )
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected_menu(events, style)


def test_menu_view_from_a_stream_in_batches(spark, tmp_path):
    events = sorted(menu_events(40, 9), key=lambda e: e[4])
    folder, source = str(tmp_path / "view"), str(tmp_path / "events")
    views.start_view(spark.createDataFrame(STATE, MENU), folder, "menu", "item_id", 8)
    for part in range(0, 40, 10):
        spark.createDataFrame(events[part : part + 10], MESSAGES["menu_change"]).coalesce(1).write.mode("append").json(source)
    stream = read_events(spark, source, "menu_change", files_per_trigger=1)
    query = views.keep_view(
        stream, folder, "menu", lambda s, b: views.merge_menu_events(s, b, "customer"), str(tmp_path / "cp"), "item_id", 8
    )
    query.awaitTermination()
    assert store.latest_version(spark, folder) == 4
    got = store.current(spark, folder, "menu")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected_menu(events, "customer")


def test_category_view(spark, make):
    state = make("category_id INT, category_name STRING, is_active BOOLEAN", (1, "A", True), (2, "B", True))
    events = spark.createDataFrame(
        [
            ("update", 1, {"category_name": "A2"}, NOW, 1),
            ("add", 2, {"category_name": "again"}, NOW, 2),
            ("update", 3, {"category_name": "too early"}, NOW, 3),
            ("add", 3, {"category_name": "C", "is_active": "1"}, NOW, 4),
        ],
        MESSAGES["category_change"],
    )
    got = views.merge_category_events(state, events)
    assert rows_of(got) == [(1, "A2", None), (2, "B", True), (3, "C", True)]


def test_order_updates_in_both_styles(spark, make):
    state = make("order_id BIGINT, total_amount DECIMAL(12,2), status STRING, payment_status STRING", (1, D("5.00"), "pending", "pending"))
    update = "order_id BIGINT, total_amount DECIMAL(12,2), status STRING, payment_status STRING, at TIMESTAMP, seq BIGINT"
    events = make(update, (1, D("6.00"), "ready", None, NOW, 2), (1, D("9.00"), "lost", "paid", NOW, 1), (7, D("1.00"), "ready", "paid", NOW, 3))
    assert rows_of(views.merge_order_updates(state, events, "admin")) == [(1, D("6.00"), "ready", None)]
    assert rows_of(views.merge_order_updates(state, events, "customer")) == [(1, D("5.00"), "ready", None)]


# Carts ----------------------------------------------------------------------------


def cart_events(n, seed):
    rng = random.Random(seed)
    return [
        (
            n_event,
            NOW + timedelta(seconds=n_event // 2 * 20),
            rng.randint(1, 3),
            action,
            None if action == "clear" else rng.randint(1, 3),
            rng.randint(-1, 4) if action == "set" else None,
        )
        for n_event, action in enumerate(rng.choices(["add", "set", "remove", "clear"], [6, 4, 1, 0.4], k=n))
    ]


def expected_carts(events):
    carts_now = {}
    for _, _, user, action, item, quantity in sorted(events, key=lambda e: (e[1], e[0])):
        cart = carts_now.setdefault(user, {})
        if action == "clear":
            cart.clear()
        elif action == "add":
            cart[item] = cart.get(item, 0) + 1
        elif action == "remove" or quantity <= 0:
            cart.pop(item, None)
        elif item in cart:
            cart[item] = quantity
    return sorted((u, i, q) for u, cart in carts_now.items() for i, q in cart.items())


@pytest.mark.parametrize("seed", range(4))
def test_cart_lines(spark, seed):
    events = cart_events(60, seed)
    frame = spark.createDataFrame(events, MESSAGES["cart"])
    assert sorted(map(tuple, carts.cart_lines(frame).collect())) == expected_carts(events)
    half = carts.cart_lines(spark.createDataFrame(events[:30], MESSAGES["cart"]))
    rest = carts.cart_lines(spark.createDataFrame(events[30:], MESSAGES["cart"]), half)
    assert sorted(map(tuple, rest.collect())) == expected_carts(events)


def event_files(spark, events, kind, folder, size):
    """Write events in files of ``size``, slightly out of order across files."""
    order = [*events]
    for n in range(size - 1, len(order) - 1, size):
        order[n], order[n + 1] = order[n + 1], order[n]
    for n in range(0, len(order), size):
        spark.createDataFrame(order[n : n + size], MESSAGES[kind]).coalesce(1).write.mode("append").json(folder)


def due(events, minutes=10):
    until = max(e[1] for e in events) - timedelta(minutes=minutes)
    return [e for e in events if e[1] <= until]


@pytest.mark.parametrize("how", ["published", "keyed state"])
def test_cart_stream_in_batches(spark, tmp_path, how):
    events = cart_events(90, 7)
    source = str(tmp_path / "events")
    event_files(spark, events, "cart", source, 30)
    stream = read_events(spark, source, "cart", files_per_trigger=1)
    if how == "published":
        carts.keep_carts(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
        got = store.current(spark, str(tmp_path / "state"), "carts")
    else:
        got = carts.newest_carts(drain(carts.cart_state(stream), str(tmp_path / "out"), "update"))
    assert sorted(map(tuple, got.collect())) == expected_carts(due(events))


# Connections ------------------------------------------------------------------------


def connection_events(n, seed):
    rng = random.Random(seed)
    return [
        (k, NOW + timedelta(minutes=47 * k), rng.randint(1, 4), rng.choice(["connect", "disconnect"])) for k in range(n)
    ]


def expected_sessions(events):
    opened, out = {}, []
    for _, at, user, action in sorted(events, key=lambda e: (e[1], e[0])):
        start = opened.pop(user, None)
        if start is not None:
            closed = action == "disconnect"
            out.append((user, start, at if closed else None, "closed" if closed else "superseded"))
        if action == "connect":
            opened[user] = at
    return out, [(u, s, None, "live") for u, s in opened.items()]


def by_start(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def test_connection_sessions(spark):
    events = connection_events(150, 3)  # spans several days
    got = connections.connection_sessions(spark.createDataFrame(events, MESSAGES["connection"]))
    ended, live = expected_sessions(events)
    assert by_start(map(tuple, got.select("user_id", "started_at", "ended_at", "state").collect())) == by_start(ended + live)
    row = got.filter("state = 'closed'").first()
    assert row.duration_ms == (row.ended_at - row.started_at).total_seconds() * 1000


@pytest.mark.parametrize("how", ["published", "keyed state"])
def test_connection_stream_in_batches(spark, tmp_path, how):
    events = connection_events(90, 5)
    source = str(tmp_path / "events")
    event_files(spark, events, "connection", source, 30)
    stream = read_events(spark, source, "connection", files_per_trigger=1)
    delay = "2 hours"
    if how == "published":
        connections.keep_sessions(stream, str(tmp_path / "state"), str(tmp_path / "cp"), delay).awaitTermination()
        got = connections.ended_sessions(spark, str(tmp_path / "state"))
    else:
        got = drain(connections.connection_stream(stream, delay), str(tmp_path / "out"))
    ended, _ = expected_sessions(due(events, 120))
    assert by_start(map(tuple, got.select("user_id", "started_at", "ended_at", "state").collect())) == by_start(ended)


# Other feeds --------------------------------------------------------------------------


def test_new_orders_are_deduplicated_in_the_stream(spark, tmp_path):
    rows = [(n % 5, f"ORD{n}", D("1.00"), 1, "ann", "asap", None, NOW + timedelta(seconds=n), n) for n in range(10)]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, MESSAGES["order_new"]).coalesce(1).write.json(source)
    got = drain(feeds.new_order_feed(read_events(spark, source, "order_new")), str(tmp_path / "out"))
    assert sorted(r.order_id for r in got.collect()) == [0, 1, 2, 3, 4]


def test_routing_and_the_sink_per_audience(spark, tmp_path, make):
    events = make(
        "event STRING, user_id BIGINT, status_sent BOOLEAN",
        ("order:update", 7, True),
        ("order:update", 7, False),
        ("category:update", None, True),
        ("category:update", None, False),
        ("menu:item:add", None, None),
        ("category:add", None, True),
    )
    routed = feeds.route(events)
    assert rows_of(routed.filter("room <> 'admins'"), "event", "room") == [
        ("menu:full:refresh", "customers"), ("menu:item:add", "customers"), ("order:update", "user:7"),
    ]
    source, out = str(tmp_path / "events"), str(tmp_path / "rooms")
    events.coalesce(1).write.json(source)
    stream = feeds.route(spark.readStream.schema(events.schema).json(source))
    write_by_room(stream, out, str(tmp_path / "cp")).awaitTermination()
    back = spark.read.parquet(out)
    assert {r.audience: r["count"] for r in back.groupBy("audience").count().collect()} == {"admins": 6, "customers": 2, "user": 1}


def test_late_requests_within_the_delay_are_counted(spark, tmp_path):
    start = NOW.replace(minute=0)
    at = [0, 60, 20, 3600, 3700, 30, 90_000]  # seconds; 20 and 30 come late, 30 too late
    rows = [(start + timedelta(seconds=s), "1.2.3.4", "GET", "/api/menu", 500 if s == 60 else 200, s) for s in at]
    source = str(tmp_path / "events")
    for row in rows:
        spark.createDataFrame([row], MESSAGES["request"]).coalesce(1).write.mode("append").json(source)
    stream = read_events(spark, source, "request", files_per_trigger=1)
    got = drain(traffic.request_metrics(stream), str(tmp_path / "out"))
    assert rows_of(got, "requests", "errors", "p95_ms") == [(2, 0, 3700), (3, 1, 60)]


def test_configured_limits(make):
    requests = make(MESSAGES["request"], *[(NOW + timedelta(seconds=n), "c", "POST", "/api/orders", 200, 1) for n in range(4)])
    over = traffic.limit_violations(requests, "order")
    assert rows_of(over, "client", "requests") == [("c", 4)]
    assert traffic.limit_violations(requests, "sign_in").count() == 0


def test_activity_sessions(spark, tmp_path):
    rows = [(n, NOW + timedelta(minutes=m), 1, "connect") for n, m in enumerate([0, 10, 100, 600])]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, MESSAGES["connection"]).coalesce(1).write.json(source)
    got = drain(connections.activity_sessions(read_events(spark, source, "connection")), str(tmp_path / "out"))
    assert rows_of(got, "events") == [(1,), (2,)]


@pytest.mark.parametrize("rows", [1, 10_000])
def test_waiting_events_of_many_minutes_and_of_one(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(ordered, "FOLD_ROWS", rows)
    events = cart_events(60, 11) + [(100 + n, NOW + timedelta(minutes=4, milliseconds=n % 2), 1, "add", 2, None) for n in range(20)]
    events.append((900, NOW + timedelta(minutes=14, seconds=1), 9, "add", 1, None))  # the watermark ends inside a minute
    source = str(tmp_path / "events")
    event_files(spark, events, "cart", source, 30)
    stream = read_events(spark, source, "cart", files_per_trigger=1)
    got = carts.newest_carts(drain(carts.cart_state(stream), str(tmp_path / "out"), "update"))
    assert sorted(map(tuple, got.collect())) == expected_carts(due(events))


class Store:
    """One key's state in memory, which counts the accesses."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        return Variable(self, name)

    getMapState = lambda self, name, key, schema: Variable(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Variable:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def __getattr__(self, call):
        values, place = self.store.values, lambda key: (self.name, key)
        self.store.calls += 1
        return {
            "get": lambda: values.get(place(())),
            "update": lambda value: values.__setitem__(place(()), value),
            "clear": lambda: values.pop(place(()), None),
            "containsKey": lambda key: place(key) in values,
            "getValue": lambda key: values[place(key)],
            "updateValue": lambda key, value: values.__setitem__(place(key), value),
            "removeKey": lambda key: values.pop(place(key)),
            "keys": lambda: iter([key for name, key in values if name == self.name]),
        }[call]


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return int(pd.Timestamp(self.at).value // 1_000_000)


@pytest.mark.parametrize("most, calls", [(10_000, 40), (7, 10_000)])
def test_few_messages_to_the_state_store(monkeypatch, most, calls):
    monkeypatch.setattr(ordered, "FOLD_ROWS", most)
    events = [(k, at, 1, *rest) for k, at, _, *rest in cart_events(300, 3)]
    held, processor, got = Store(), carts.CartProcessor(), {}
    processor.init(held)
    for n in range(0, 300, 60):
        part = pd.DataFrame(events[n : n + 60], columns=["event_id", "ts", "user_id", "action", "item_id", "quantity"])
        frames = [part.iloc[::-2], part.iloc[::2]] if n % 120 else [part]
        assert list(processor.handleInputRows((1,), iter(frames), None)) == []
        until = part["ts"].max() - timedelta(minutes=10)
        for timer in sorted(t for t in held.timers if t <= Clock(until).getCurrentWatermarkInMs()):
            held.timers.discard(timer)
            for rows in processor.handleExpiredTimer((1,), Clock(until), None):
                got |= dict(zip(rows["item_id"], rows["quantity"]))
    assert sorted((1, i, q) for i, q in got.items() if q) == expected_carts(due(events))
    assert held.calls <= calls
