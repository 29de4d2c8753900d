"""Request log in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.functions.domains import RATE_LIMITS

#: Size of a latency sketch: latencies are kept as they are up to about this number.
SKETCH_ITEMS = 4_096


def _watermarked(requests: DataFrame, delay: str) -> DataFrame:
    return requests.withWatermark("ts", delay) if requests.isStreaming else requests


def rate_violations(requests: DataFrame, limit: int, window: str, delay: str = "10 minutes") -> DataFrame:
    """Clients with more than ``limit`` requests in a tumbling window."""
    counts = (
        _watermarked(requests, delay)
        .groupBy(F.window("ts", window).alias("w"), "client")
        .agg(F.count("*").alias("requests"))
    )
    return counts.filter(F.col("requests") > limit).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "client", "requests"
    )


def limit_violations(requests: DataFrame, name: str, delay: str = "10 minutes") -> DataFrame:
    """Violations of one of the configured limits, all, sign_in or order, in windows aligned to the epoch, which a
    stream can close. ``tiffin.operators.limits`` has the windows that begin with a client's requests."""
    limit, window = RATE_LIMITS[name]
    return rate_violations(requests, limit, window, delay)


def request_sketches(requests: DataFrame, window: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per route and window what ``request_figures`` needs: counts, sums and a KLL sketch of latency.

    All of them can be merged: over tasks, micro-batches, routes and windows. Works on streams and tables.
    """
    return (
        _watermarked(requests, delay)
        .groupBy(F.window("ts", window).alias("w"), "method", "path")
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("status") >= 400).alias("errors"),
            F.sum("duration_ms").alias("total_ms"),
            F.kll_sketch_agg_bigint(F.col("duration_ms").cast("bigint"), F.lit(SKETCH_ITEMS)).alias("latency"),
        )
        .select(F.col("w.start").alias("window_start"), "method", "path", "requests", "errors", "total_ms", "latency")
    )


def rolled_up(sketches: DataFrame, unit: str = "day", keys: tuple[str, ...] = ("method", "path")) -> DataFrame:
    """``request_sketches`` of short windows merged to calendar units, and to fewer ``keys`` if asked for."""
    return sketches.groupBy(F.date_trunc(unit, "window_start").alias("window_start"), *keys).agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        F.sum("total_ms").alias("total_ms"),
        F.kll_merge_agg_bigint("latency", F.lit(SKETCH_ITEMS)).alias("latency"),
    )


def request_figures(sketches: DataFrame) -> DataFrame:
    """Requests, errors, and mean and 95th percentile of latency; the last two are NULL without latencies.

    The percentile is the smallest latency that is not below 95 % of them: exact as long as a sketch holds all
    of its latencies (SKETCH_ITEMS), else one whose rank is off by less than 0.1 % or so of their number.
    """
    timed = F.kll_sketch_get_n_bigint("latency")
    quantile = F.when(timed > 0, F.kll_sketch_get_quantile_bigint("latency", F.lit(0.95)))
    keys = [c for c in sketches.columns if c not in ("requests", "errors", "total_ms", "latency")]
    return sketches.select(
        *keys,
        "requests",
        "errors",
        F.when(timed > 0, F.col("total_ms").cast("double") / timed).alias("mean_ms"),
        quantile.cast("int").alias("p95_ms"),
    )


def request_metrics(requests: DataFrame, window: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests, errors, and mean and 95th percentile of latency per route and window."""
    return request_figures(request_sketches(requests, window, delay))
