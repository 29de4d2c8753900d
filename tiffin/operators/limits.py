"""Request limits per client, in windows that begin with a client's own requests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiffin.functions.domains import RATE_LIMITS
from tiffin.session import pin


def _micros(window: str) -> int:
    """Length of a window such as ``15 minutes``."""
    return int(pd.Timedelta(window) / pd.Timedelta("1us"))


def first_later(moments: DataFrame, length: int) -> DataFrame:
    """``moments`` (client, at; each once) with ``next``, the client's first moment at least ``length`` later, and
    ``head``, whether the one before is at least that much earlier or missing.

    Moments lie in cells of ``length``: the next one is in the following cell or is the first of the one after, so a
    client's moments are sorted cell by cell, and only one row per cell is ordered across a client.
    """
    cell = F.floor(F.col("at") / length)
    placed = moments.withColumn("cell", cell)
    along = Window.partitionBy("client").orderBy("cell")
    cells = placed.groupBy("client", "cell").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    # What lies beyond the following cell: its successor if it has moments itself, else the next one that has.
    follows = F.lead("cell").over(along) == F.col("cell") + 1
    beyond = F.when(follows, F.lead("_first", 2).over(along)).otherwise(F.lead("_first").over(along))
    cells = cells.select("client", "cell", F.lag("_last").over(along).alias("_earlier"), beyond.alias("_beyond"))
    inside = Window.partitionBy("client", "cell").orderBy("at")
    own = placed.join(cells, ["client", "cell"]).withColumn(
        "_before", F.coalesce(F.lag("at").over(inside), "_earlier")
    )
    own = own.withColumn("head", F.coalesce(F.col("at") - F.col("_before") >= length, F.lit(True)))
    # Each moment asks in the following cell for the first moment not before its own place there.
    asked = own.select(
        "client", (F.col("cell") + 1).alias("cell"), (F.col("at") + length).alias("place"), F.lit(None).cast("long").alias("_found"),
        F.struct("at", "head", "_beyond", "_before").alias("_asks"),
    )
    there = placed.select(
        "client", "cell", F.col("at").alias("place"), F.col("at").alias("_found"), F.lit(None).cast(asked.schema["_asks"].dataType).alias("_asks")
    )
    # From the last place backwards, so that the smallest so far is kept along: a frame that ends with the partition is
    # gone through anew for every row.
    onward = Window.partitionBy("client", "cell").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    answered = asked.unionByName(there).withColumn("_next", F.min("_found").over(onward)).filter("_asks IS NOT NULL")
    return answered.select(
        "client", F.col("_asks.at").alias("at"), F.col("_asks.head").alias("head"), F.col("_asks._before").alias("before"),
        F.coalesce("_next", "_asks._beyond").alias("next"),
    )


def window_starts(moments: DataFrame, length: int) -> DataFrame:
    """(client, at) of the moments that open a window: the first of a client, and after each the first that is at least
    ``length`` later.

    A moment at least ``length`` after the one before always opens a window, so chains run from such heads, side by
    side. Along a chain the pointers to the next opening are doubled: each round joins every moment with the target of
    its target, and takes what the openings found so far point to. The longest stretch between two heads bounds the
    number of rounds, by its logarithm.
    """
    pointers = pin(first_later(moments, length))
    heads = pointers.filter("head")
    # A stretch ends with the moment before the next head, or with the client's last one.
    last = pointers.groupBy("client").agg(F.max("at").alias("_last"))
    stop = F.lead("before").over(Window.partitionBy("client").orderBy("at"))
    ends = heads.withColumn("_stop", stop).join(last, "client")
    longest = ends.agg(F.max(F.coalesce("_stop", "_last") - F.col("at"))).first()[0]
    opened = heads.select("client", "at")
    rounds = math.ceil(math.log2((longest or 0) // length + 1))
    jump = pointers.filter("next IS NOT NULL").select("client", "at", "next")
    for turn in range(rounds):
        opened = pin(opened.unionByName(opened.join(jump, ["client", "at"]).select("client", F.col("next").alias("at"))).distinct())
        if turn + 1 < rounds:
            onward = jump.select("client", F.col("at").alias("next"), F.col("next").alias("_further"))
            jump = pin(jump.join(onward, ["client", "next"]).select("client", "at", F.col("_further").alias("next")))
    return opened


def client_windows(requests: DataFrame, window: str) -> DataFrame:
    """window_start, window_end, client and requests of all windows of ``requests`` (ts, client).

    A client's first request opens a window; the first one at or after its end opens the next. So a burst
    is counted whole, wherever the clock stands. Requests without time are in no window; those without client are one
    client. Requests of equal time count each.
    """
    length = _micros(window)
    # A missing client is a key of its own in joins, too.
    key = F.coalesce(F.concat(F.lit("="), F.col("client").cast("string")), F.lit(""))
    moments = pin(
        requests.filter("ts IS NOT NULL")
        .select(key.alias("client"), F.unix_micros("ts").alias("at"))
        .groupBy("client", "at")
        .agg(F.count("*").alias("_many"))
    )
    starts = window_starts(moments.select("client", "at"), length)
    # A window reaches into its own cell and the following one; a moment is in one window.
    cell = F.floor(F.col("at") / length)
    spread = starts.select("client", F.col("at").alias("_start"), F.explode(F.array(cell, cell + 1)).alias("_cell"))
    within = (F.col("at") >= F.col("_start")) & (F.col("at") < F.col("_start") + length)
    counted = moments.withColumn("_cell", cell).join(spread, ["client", "_cell"]).filter(within)
    counted = counted.groupBy("client", "_start").agg(F.sum("_many").alias("requests"))
    return counted.select(
        F.timestamp_micros("_start").alias("window_start"),
        F.timestamp_micros(F.col("_start") + length).alias("window_end"),
        F.when(F.col("client") != "", F.substring("client", 2, 2**31 - 1)).alias("client"),
        "requests",
    )


def limit_violations(requests: DataFrame, name: str) -> DataFrame:
    """Windows of clients with more requests than one of the configured limits allows: all, sign_in or order."""
    limit, window = RATE_LIMITS[name]
    return client_windows(requests, window).filter(F.col("requests") > limit)
