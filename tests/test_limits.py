"""Windows per client against following every request."""

from collections import Counter, defaultdict
from datetime import timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import NOW, rows_of
from tiffin.operators.limits import client_windows, first_later, limit_violations
from tiffin.sources.schemas import MESSAGES


def expected(requests, length):
    out, opened = Counter(), {}
    for ts, client in sorted((r for r in requests if r[0] is not None), key=lambda r: r[0]):
        if client not in opened or ts >= opened[client] + length:
            opened[client] = ts
        out[client, opened[client]] += 1
    return dict(out)


def found(df):
    return {(r.client, r.window_start): r.requests for r in df.collect()}


def requests(make, rows):
    return make("ts timestamp, client string", *rows)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.sampled_from(["a", "b", "", None])), max_size=120), st.integers(1, 90))
def test_windows(spark, rows, seconds):
    rows = [(NOW + timedelta(seconds=s), client) for s, client in rows]
    made = spark.createDataFrame(rows, "ts timestamp, client string")
    length = timedelta(seconds=seconds)
    assert found(client_windows(made, f"{seconds} seconds")) == expected(rows, length)


def test_a_long_unbroken_stretch(make):
    rows = [(NOW + timedelta(seconds=7 * n, microseconds=n * n), "busy") for n in range(3_000)]
    rows += [(None, "busy"), (NOW - timedelta(days=9_000), "busy"), (NOW, None)]
    assert found(client_windows(requests(make, rows), "1 minute")) == expected(rows, timedelta(minutes=1))


def test_a_burst_across_a_clock_boundary_is_found(make):
    at = [NOW + timedelta(seconds=s) for s in (-20, -10, 5, 15)]
    rows = [(ts, "c", "POST", "/api/orders", 200, 1) for ts in at]
    assert rows_of(limit_violations(make(MESSAGES["request"], *rows), "order"), "client", "requests") == [("c", 4)]


def test_no_requests(make):
    assert client_windows(requests(make, []), "1 minute").collect() == []


def test_a_request_at_the_end_opens_the_next_window(make):
    rows = [(NOW + timedelta(minutes=n), "c") for n in range(4)] + [(NOW, "c")]
    by_start = defaultdict(int, found(client_windows(requests(make, rows), "1 minute")))
    assert sorted(by_start.values()) == [1, 1, 1, 2]


def test_no_frame_is_gone_through_anew_for_every_row(make):
    found = first_later(make("client string, at long", ("c", 1), ("c", 5), ("c", 12)), 5)
    assert rows_of(found, "at", "next") == [(1, 12), (12, None), (5, 12)]
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
