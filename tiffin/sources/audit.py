"""Audit rows with JSON images of a row before and after a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.operators.sequences import number_rows

IMAGE = "map<string,string>"


def capture(
    before: DataFrame, after: DataFrame, key: str, entity: str, at: Column, user_id: int | None = None, last_id: int = 0
) -> DataFrame:
    """Audit rows of the change of a table from one version to another, numbered from ``last_id + 1``.

    Both versions have the same columns and unique keys. A row that is new has its whole image in ``new_values``, one
    that is gone in ``old_values``, one that changed its changed fields in both; NULLs are compared as values and kept in
    the images. Rows that are the same in both versions have no audit row. Values are written as text.
    """
    fields = [c for c in before.columns if c != key]
    image = F.struct(*[F.col(c).cast("string").alias(c) for c in fields])
    old = before.select(key, image.alias("_old"))
    both = old.join(after.select(key, image.alias("_new")), key, "full")
    added, gone = F.col("_old").isNull(), F.col("_new").isNull()

    def values(side: str) -> Column:
        sent = [
            F.when(
                added | gone | ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")),
                F.struct(F.lit(c).alias("key"), F.col(f"{side}.{c}").alias("value")),
            )
            for c in fields
        ]
        return F.when(F.col(side).isNotNull(), F.map_from_entries(F.array_compact(F.array(*sent))))

    rows = both.select(
        F.lit(user_id).cast("bigint").alias("user_id"),
        F.when(added, "insert").when(gone, "delete").otherwise("update").alias("action"),
        F.lit(entity).alias("entity_type"),
        F.col(key).cast("bigint").alias("entity_id"),
        values("_old").alias("_before"),
        values("_new").alias("_after"),
    )
    rows = rows.filter((F.size(F.coalesce("_before", "_after")) > 0) | (F.col("action") != "update"))
    keep = {"ignoreNullFields": "false"}
    rows = rows.select(
        "user_id",
        "action",
        "entity_type",
        "entity_id",
        F.to_json("_before", keep).alias("old_values"),
        F.to_json("_after", keep).alias("new_values"),
        F.lit(None).cast("string").alias("ip_address"),
        at.cast("timestamp").alias("created_at"),
    )
    return number_rows(rows, [F.col("entity_id")], "log_id", last_id)


def apply_audit(before: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The version that the audit ``rows`` of one change lead to from ``before``."""
    logged = rows.select(
        F.col("entity_id").cast(before.schema[key].dataType).alias(key),
        F.struct("action", F.from_json("new_values", IMAGE).alias("image")).alias("_log"),
    )
    both = before.withColumn("_known", F.lit(True)).join(logged, key, "full")
    image = F.col("_log.image")

    def field(f) -> Column:
        sent = F.coalesce(F.map_contains_key(image, f.name), F.lit(False))
        return F.when(sent, image[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)

    kept = both.filter(F.col("_log").isNull() | (F.col("_log.action") != "delete"))
    return kept.select(*[F.col(key) if f.name == key else field(f) for f in before.schema]).select(*before.columns)


def audit_changes(audit_logs: DataFrame) -> DataFrame:
    """One row per changed field; a field missing on one side has NULL there."""
    empty = F.create_map().cast(IMAGE)
    before = F.coalesce(F.from_json("old_values", IMAGE), empty)
    after = F.coalesce(F.from_json("new_values", IMAGE), empty)
    images = audit_logs.withColumns({"_before": before, "_after": after})
    fields = F.array_union(F.map_keys("_before"), F.map_keys("_after"))
    changed = F.filter(fields, lambda f: ~F.col("_before")[f].eqNullSafe(F.col("_after")[f]))
    return images.select(
        "log_id",
        "user_id",
        "action",
        "entity_type",
        "entity_id",
        "created_at",
        F.explode(changed).alias("field"),
        "_before",
        "_after",
    ).select(
        "log_id",
        "user_id",
        "action",
        "entity_type",
        "entity_id",
        "created_at",
        "field",
        F.col("_before")[F.col("field")].alias("old_value"),
        F.col("_after")[F.col("field")].alias("new_value"),
    )
