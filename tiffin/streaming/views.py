"""Live views: keyed tables folded from change events.

Each merge is a pure function of (state, events of a batch). Events of one key do
not commute, but their outcome needs only a few extreme events: the last one that
removes the row, the first later one that adds it, and the last value sent for
each field. Two aggregates find them, one per pass over the events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiffin.sources import store
from tiffin.sources.store import newest_rows

STYLES = ("customer", "admin")


def _at() -> Column:
    return F.struct("at", "seq")


def _sent(field: str) -> Column:
    return F.map_contains_key("payload", field)


def _inactive() -> Column:
    flag = F.lower(F.col("payload")["is_active"])
    return F.coalesce(_sent("is_active") & flag.isin("0", "false"), F.lit(False))



def _after_reset(events: DataFrame, key: str, resets: Column, adds: Column, changes: Column) -> DataFrame:
    """Events with ``_reset``, the last one that removes the row, and ``_counts``: adds and changes after it."""
    marked = events.withColumns({"_resets": resets, "_adds": adds, "_changes": changes, "_at": _at()})
    removed = marked.filter("_resets").groupBy(key).agg(F.max("_at").alias("_reset"))
    later = F.col("_reset").isNull() | (F.col("_at") > F.col("_reset"))
    return marked.join(removed, key, "left").withColumn("_counts", (F.col("_adds") | F.col("_changes")) & later)


def _counted(value: Column) -> Column:
    return F.when(F.col("_counts"), value)


def _first_add() -> Column:
    return F.min(_counted(F.when(F.col("_adds"), F.col("_at")))).alias("_born")


def _with_state(state: DataFrame, folded: DataFrame, key: str) -> DataFrame:
    """State rows next to what the batch did to their keys.

    ``_stays``: the row was there and is not removed. ``_lives``: it is there at the
    end, because it stays or because it was added after the last removal.
    """
    stays = F.col("_known").isNotNull() & F.col("_reset").isNull()
    both = state.withColumn("_known", F.lit(True)).join(folded, key, "full").withColumn("_stays", stays)
    return both.filter(F.col("_stays") | F.col("_born").isNotNull())


def _merge_fields(state: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """Field by field: sent values replace, other fields stay.

    A new row takes only values sent at or after its first add. If the last value of
    a field is older than that, no later one was sent.
    """
    fields = [f for f in state.schema if f.name != key]
    aggregates = [_first_add(), F.max("_reset").alias("_reset")]
    for field in fields:
        sent_at = _counted(F.when(_sent(field.name), F.col("_at")))
        last = F.max_by(F.struct(F.col("payload")[field.name].alias("value"), F.col("_at").alias("at")), sent_at)
        aggregates.append(last.alias(f"_last_{field.name}"))
    both = _with_state(state, alive.groupBy(key).agg(*aggregates), key)

    def merged(field) -> Column:
        last = F.col(f"_last_{field.name}")
        usable = last.isNotNull() & (F.col("_stays") | (last["at"] >= F.col("_born")))
        kept = F.when(F.col("_stays"), F.col(field.name))
        return F.when(usable, last["value"].try_cast(field.dataType)).otherwise(kept).alias(field.name)

    return both.select(key, *[merged(f) for f in fields]).select(*state.columns)


def _replace_rows(state: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """The last update replaces the row; without one, the first add makes it."""
    fields = [f for f in state.schema if f.name != key]
    update_at = _counted(F.when(F.col("_changes"), F.col("_at")))
    add_at = _counted(F.when(F.col("_adds"), F.col("_at")))
    folded = alive.groupBy(key).agg(
        _first_add(),
        F.max("_reset").alias("_reset"),
        F.max(update_at).alias("_updated"),
        F.max_by("payload", update_at).alias("_update"),
        F.min_by("payload", add_at).alias("_add"),
    )
    both = _with_state(state, folded, key)
    updated = F.col("_updated").isNotNull() & (F.col("_stays") | (F.col("_updated") > F.col("_born")))
    row = F.when(updated, F.col("_update")).when(~F.col("_stays"), F.col("_add"))
    replaced = both.withColumn("_row", row)
    return replaced.select(
        key,
        *[
            F.when(F.col("_row").isNull(), F.col(f.name))
            .otherwise(F.col("_row")[f.name].try_cast(f.dataType))
            .alias(f.name)
            for f in fields
        ],
    ).select(*state.columns)


def merge_menu_events(state: DataFrame, events: DataFrame, style: str) -> DataFrame:
    """Menu rows after add, update and delete events.

    ``customer``: an add or update merges its fields, an inactive update removes the
    item, an inactive add is ignored. ``admin``: the first add wins, an update
    replaces the whole row. Updates of unknown items are ignored in both.
    """
    if style == "customer":
        resets = (F.col("op") == "delete") | ((F.col("op") == "update") & _inactive())
        adds = (F.col("op") == "add") & ~_inactive()
        updates = (F.col("op") == "update") & ~_inactive()
        return _merge_fields(state, _after_reset(events, "item_id", resets, adds, updates), "item_id")
    op = F.col("op")
    return _replace_rows(
        state, _after_reset(events, "item_id", op == "delete", op == "add", op == "update"), "item_id"
    )


def merge_category_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """Category rows after add and update events; a repeated add changes nothing."""
    op = F.col("op")
    return _replace_rows(
        state, _after_reset(events, "category_id", F.lit(False), op == "add", op == "update"), "category_id"
    )


def merge_order_updates(state: DataFrame, events: DataFrame, style: str) -> DataFrame:
    """Order rows after update events; updates of unknown orders are ignored.

    ``admin``: the update replaces every field it carries. ``customer``: only the
    two status fields change.
    """
    last = newest_rows(events, "order_id", ["at", "seq"])
    fields = ["status", "payment_status"]
    if style == "admin":
        fields = [c for c in state.columns if c in events.columns and c != "order_id"]
    new = last.select("order_id", F.struct(*fields).alias("_new"))
    hit = F.col("_new").isNotNull()
    columns = {f: F.when(hit, F.col(f"_new.{f}").cast(state.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    return state.join(new, "order_id", "left").withColumns(columns).select(*state.columns)


def start_view(state: DataFrame, folder: str, table: str, key: str, buckets: int = store.BUCKETS) -> None:
    """Publish the state that ``keep_view`` starts from."""
    store.publish({table: store.Buckets(state, key, None, buckets)}, folder, 0)


def keep_view(
    stream: DataFrame,
    folder: str,
    table: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
    key: str,
    buckets: int = store.BUCKETS,
) -> StreamingQuery:
    """Fold a stream into a table published in buckets of its key, one version per micro-batch.

    Version 0 holds the state to start from (``start_view``). A micro-batch reads and writes only the buckets that its
    keys are in. A replayed one reads the version before it again and replaces its own. ``merge`` may
    change rows of the batch's keys only.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch.persist()
        try:
            hit = store.touched(batch, key, buckets)
            state = store.in_buckets(spark, folder, table, batch_id, hit)
            store.publish({table: store.Buckets(merge(state, batch), key, hit, buckets)}, folder, batch_id + 1)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
