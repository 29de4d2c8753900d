"""Latency sketches: exact while they hold everything, close in rank beyond, and the same however they are merged."""

from datetime import timedelta

import numpy as np

from tests.conftest import NOW, rows_of
from tiffin.sources.schemas import MESSAGES
from tiffin.streaming.traffic import request_figures, request_metrics, request_sketches, rolled_up

START = NOW.replace(hour=0)


def log(spark, durations, spread=timedelta(hours=20)):
    step = spread / max(1, len(durations))
    rows = [(START + n * step, "c", "GET", f"/{n % 3}", 200, d) for n, d in enumerate(durations)]
    return spark.createDataFrame(rows, MESSAGES["request"])


def test_small_windows_are_exact(spark):
    got = request_metrics(log(spark, [5, 1, 9, None, 7, 3], timedelta(minutes=5)), "1 day")
    assert rows_of(got, "path", "requests", "mean_ms", "p95_ms") == [
        ("/0", 2, 5.0, 5), ("/1", 2, 4.0, 7), ("/2", 2, 6.0, 9),
    ]
    none = request_metrics(log(spark, [None, None, None]), "1 day")
    assert {(r.requests, r.mean_ms, r.p95_ms) for r in none.collect()} == {(1, None, None)}


def test_merged_sketches_stay_close_in_rank(spark):
    durations = [int(d) for d in np.random.default_rng(5).lognormal(5, 1.5, 120_000)]
    quarters = request_sketches(log(spark, durations))
    day = request_figures(rolled_up(quarters, "day", ())).collect()
    assert len(day) == 1 and day[0].requests == len(durations)
    assert abs(day[0].mean_ms - sum(durations) / len(durations)) < 1e-6
    ranked = np.sort(durations)
    low, high = np.searchsorted(ranked, day[0].p95_ms, "left"), np.searchsorted(ranked, day[0].p95_ms, "right")
    assert low / len(ranked) - 0.005 <= 0.95 <= high / len(ranked) + 0.005
