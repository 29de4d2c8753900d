"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiffin.llm.common import pinned, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Sources by code point, null last, take the weights in turn. The water level rises until the targets
    ``weight * level``, each clamped at ``epochs`` times its source, add up to ``share`` times all sizes: in
    the order of the level at which sources clamp, a source is clamped if the level that the sources from it
    on would share reaches its own clamp level. The others share the level of the first of them, which is the
    largest. This is where clamping and sharing the excess anew by weight ends. One row per source: the windows
    below run over sources, not documents.
    """
    if share > epochs:
        raise ValueError("share above the maximum of epochs")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    listed = sources.withColumn("_turn", turn).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_turn") % len(weights) + 1)
    )
    listed = listed.withColumn("_cap", F.col("source_size") * float(epochs))
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_turn")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    listed = (
        listed.withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_weight").over(onward))
        .withColumn("_clamped", F.col("_level") * F.col("_weight") >= F.col("_cap"))
        .withColumn("_water", F.max(F.when(~F.col("_clamped"), F.col("_level"))).over(everything))
    )
    target = F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_water"))
    return listed.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``.

    ``size`` counts words; null texts have none. All rows are repeated whole as often as the target holds the
    source; the rest of the target is filled with documents in the order of a seeded hash of their id, the
    last one in part, so a source's taken words add up to its rounded target. Rows of equal id are ordered by
    size. Null is a source of its own. An empty table gives no rows; a source without words has target 0.

    The running sum has two steps: 4,096 hash ranges per source, then the rows of a range, so a source
    with a third of all rows is spread over that many groups.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = pinned(
        docs.select("doc_id", "source", word_count().alias("size"), key.alias("_key")).withColumn(
            "_range", F.substring("_key", 1, 3)
        )
    )
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_range_size"))
    # Rows of this table: sources times 4,096 at most.
    starts = ranges.withColumn(
        "_start",
        F.coalesce(
            F.sum("_range_size").over(
                Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    targets = source_targets(
        ranges.groupBy("source").agg(F.sum("_range_size").alias("source_size")), weights, share, epochs
    )
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    plan = plan.select(
        F.col("s.source").alias("_source"), F.col("s._range").alias("_of"), "_start", "source_size", "target"
    )
    inside = (
        Window.partitionBy("source", "_range")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    joined = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of")))
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("_whole", whole.cast("long"))
        .withColumn(
            "_rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("_whole") * F.col("source_size")
        )
    )
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    taken = F.col("_whole") * F.col("size") + part
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: the words taken, divided by the size, rounded.

    Rows without words are not taken. All columns of ``docs`` are kept, whatever their names. The rows of a
    doc_id that occurs more than once share the mean of their repetitions.
    """
    plan = (
        mix(docs, **settings)
        .groupBy(F.col("doc_id").alias("_mix_id"))
        .agg(F.sum("taken").alias("_mix_taken"), F.sum("size").alias("_mix_size"))
    )
    times = F.when(F.col("_mix_size") > 0, F.floor(F.col("_mix_taken") / F.col("_mix_size") + 0.5)).otherwise(0)
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_mix_id")))
    copies = joined.withColumn("_mix_copies", F.array_repeat(F.lit(0), times.cast("int")))
    return copies.withColumn("_mix_copy", F.explode("_mix_copies")).select(*[F.col(f"`{c}`") for c in docs.columns])
