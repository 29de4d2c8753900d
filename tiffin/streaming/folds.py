"""Folding a stream into published tables, in event-time order, without per-key code.

Each micro-batch is joined with the events held back before it. Events older than
the newest one minus the delay are due and are folded; the rest waits. State,
waiting events and clock are published as one version, so a replayed batch starts
from the version before it and gives the same result. State tables in buckets of their key are
rewritten only where the batch has due events. As every fold is a DataFrame
job, one busy key is aggregated in parts and not by one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiffin.sources import store

Tables = dict[str, DataFrame]
Fold = Callable[[Tables, DataFrame], Tables]


def fold_in_order(
    events: DataFrame,
    folder: str,
    fold: Fold,
    checkpoint: str,
    delay: str = "10 minutes",
    ts: str = "ts",
    keyed: dict[str, str] | None = None,
    buckets: int = store.BUCKETS,
) -> StreamingQuery:
    """Run ``fold(state tables, due events)`` over everything available.

    ``keyed`` names the key of each table that is kept in buckets: of these, the fold sees and writes only the buckets of
    the keys of the due events. Its other tables are written whole.
    """
    keyed = keyed or {}

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = store.table_paths(spark, folder, version=batch_id)
        state = {name: spark.read.parquet(path) for name, path in paths.items()}
        waiting, clock = state.pop("waiting", None), state.pop("clock", None)
        hit: dict[str, list[int]] = {}
        batch.persist()
        try:
            newest = batch.agg(F.max(ts).alias("newest"))
            if clock is not None:
                newest = newest.unionByName(clock).agg(F.max("newest").alias("newest"))
            until = newest.select(F.col("newest") - F.expr(f"INTERVAL {delay}")).first()[0]
            pool = batch if waiting is None else batch.unionByName(waiting)
            due = pool.filter(F.col(ts) <= F.lit(until))
            # An event without time is never due; it waits where it can be found.
            rest = pool.filter(F.col(ts).isNull() | (F.col(ts) > F.lit(until)))
            for name, key in keyed.items():
                hit[name] = store.touched(due, key, buckets)
                before = store.in_buckets(spark, folder, name, batch_id, hit[name])
                if before is not None:
                    state[name] = before
            made = fold(state, due)
            tables = {
                name: store.Buckets(df, keyed[name], hit[name], buckets) if name in keyed else df for name, df in made.items()
            }
            store.publish({**tables, "waiting": rest, "clock": newest}, folder, batch_id + 1)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
