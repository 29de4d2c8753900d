"""Sessions from connect and disconnect events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiffin.operators.sequences import previous_in_order
from tiffin.sources import store
from tiffin.streaming.folds import fold_in_order
from tiffin.streaming.ordered import OrderedProcessor


def _millis_between(start, end):
    return F.unix_millis(end) - F.unix_millis(start)


def connection_sessions(events: DataFrame) -> DataFrame:
    """Sessions of all users: closed, superseded or live.

    ``events``: event_id, ts, user_id, action. A connect is closed by the next event
    of the user if that is a disconnect, and superseded if it is another connect. A
    disconnect without open session is ignored.
    """
    steps = previous_in_order(
        events.withColumn("_step", F.struct("action", "ts")), "user_id", ["ts", "event_id"], "_step", "_previous"
    )
    ended = F.col("action") == "disconnect"
    ending = steps.filter(F.col("_previous.action") == "connect").select(
        "user_id",
        F.col("_previous.ts").alias("started_at"),
        F.when(ended, F.col("ts")).alias("ended_at"),
        F.when(ended, _millis_between(F.col("_previous.ts"), F.col("ts"))).alias("duration_ms"),
        F.when(ended, "closed").otherwise("superseded").alias("state"),
    )
    last = events.groupBy("user_id").agg(
        F.max_by(F.struct("action", "ts"), F.struct("ts", "event_id")).alias("_last")
    )
    live = last.filter(F.col("_last.action") == "connect").select(
        "user_id",
        F.col("_last.ts").alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.lit("live").alias("state"),
    )
    return ending.unionByName(live)


def keep_sessions(
    events: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes", buckets: int = store.BUCKETS
) -> StreamingQuery:
    """Stream of connection events folded into the published tables ``open``, in buckets of users, and ``ended``.

    Every version of ``ended`` holds the sessions that its micro-batch ended;
    ``ended_sessions`` reads them all.
    """

    def fold(state: dict[str, DataFrame], due: DataFrame) -> dict[str, DataFrame]:
        steps = due.select("event_id", "ts", "user_id", "action")
        if "open" in state:
            # An open session continues as the connect event that opened it.
            steps = steps.unionByName(state["open"])
        newest = F.max_by(F.struct("event_id", "ts", "action"), F.struct("ts", "event_id"))
        last = steps.groupBy("user_id").agg(newest.alias("_last"))
        still_open = last.filter(F.col("_last.action") == "connect").select("user_id", "_last.*")
        sessions = connection_sessions(steps).filter("state <> 'live'")
        return {"open": still_open.select("event_id", "ts", "user_id", "action"), "ended": sessions}

    return fold_in_order(events, folder, fold, checkpoint, delay, keyed={"open": "user_id"}, buckets=buckets)


def ended_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return store.all_versions(spark, folder, "ended")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stream of activity periods per user that end after a gap without events."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")
    )


class ConnectionProcessor(OrderedProcessor):
    """One user's open session. Emits a session when it is closed or superseded."""

    waiting_schema = "ts timestamp, event_id bigint, action string"
    output_schema = "user_id bigint, started_at timestamp, ended_at timestamp, duration_ms bigint, state string"

    def init(self, handle) -> None:
        super().init(handle)
        self.opened = handle.getValueState("opened", "ts bigint")

    def fold(self, key, events: list) -> pd.DataFrame | None:
        before = self.opened.get()
        start = before[0] if before else None
        rows = []
        for event in events:
            if start is not None:
                if event.action == "disconnect":
                    # Whole milliseconds of both ends, as the batch twin counts them.
                    rows.append((key[0], start, event.ts, event.ts // 1000 - start // 1000, "closed"))
                else:
                    rows.append((key[0], start, None, None, "superseded"))
            start = event.ts if event.action == "connect" else None
        if start is not None:
            self.opened.update((start,))
        elif before:
            self.opened.clear()
        if not rows:
            return None
        users, started, ended, lengths, states = zip(*rows)
        return pd.DataFrame(
            {
                "user_id": users,
                "started_at": np.array(started, "datetime64[us]").astype("datetime64[ns]"),
                "ended_at": np.array(ended, "datetime64[us]").astype("datetime64[ns]"),
                "duration_ms": pd.array(lengths, "Int64"),
                "state": states,
            }
        )


def connection_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of ended sessions within seconds, with state per user in the state store.

    For a backlog, or where one user may send a large share of a micro-batch, use
    ``keep_sessions``.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=ConnectionProcessor(),
            outputStructType=ConnectionProcessor.output_schema,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
