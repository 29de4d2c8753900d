"""Rows that claim names, accepted in order of arrival where every name may be claimed once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.functions.text import name_key, plain_name_key
from tiffin.session import pin
from tiffin.sources.sizes import SMALL_ROWS, has_at_most, small

#: Clashing claims that one task may go through; more are settled in rounds, or parted into components, first.
ONE_TASK_ROWS = 200_000
#: Rounds that settle the rows around names with a clear first claim, before components are looked for.
ROUNDS = 2


def first_come(rows: DataFrame, unique: list[str], order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The rows accepted when they arrive one by one in the order of ``order`` (unique per row), and a row is refused if
    one of its texts in the columns ``unique`` is that of an accepted one, or of one in ``stored``.

    A missing text never clashes. Rows that share no text with another are accepted at once. The others are gone through
    in order of arrival, by one task if they are few. If they are many, rows that are first in all their texts are
    accepted and those that clash with them refused, which settles names that very many rows claim, in rounds that go on
    while each settles half of the claims; what is left falls into components that share no text, and each is gone
    through by one task, row by row: a task remembers the texts accepted in its component, not its rows.
    """
    # Numbers that rise in order of arrival stand for the order from here on.
    rows = pin(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    claims, refused = _clashing(rows, unique, stored)
    many, rounds = claims.count(), 0
    while many > ONE_TASK_ROWS:
        lost, claims = _settled(claims)
        refused.append(lost)
        before, many, rounds = many, claims.count(), rounds + 1
        if rounds >= ROUNDS and 2 * many > before:
            break
    if many > ONE_TASK_ROWS:
        refused.append(_refused(claims.join(components(claims), "_id"), None))
    elif many:
        refused.append(_refused(claims.withColumn("_component", F.lit(0)), 1))
    if not refused:
        return rows.drop("_id")
    return rows.join(reduce(DataFrame.unionByName, refused), "_id", "left_anti").drop("_id")


def _texts(rows: DataFrame, unique: list[str], number: Column) -> DataFrame:
    """(_id, _column, _text): the texts in the columns ``unique``."""
    texts = rows.select(number.alias("_id"), F.posexplode(F.array(*unique)).alias("_column", "_text"))
    return texts.filter("_text IS NOT NULL")


def keyed(texts: DataFrame) -> DataFrame:
    """Adds ``_key`` to ``texts`` (_column, _text, ...): an ordinary string, the same for texts of a column that compare
    equal as names.

    A text of printable ASCII has its own key. Only the others are compared by the collation: each takes the key of the
    plain text that it is equal to, or else the first of those equal to it.
    """
    marked = texts.withColumn("_key", plain_name_key(F.col("_text")))
    plain, other = marked.filter("_key IS NOT NULL"), marked.filter("_key IS NULL")
    if has_at_most(other, 0):
        return marked
    odd = pin(other.select("_column", "_text").distinct())
    named = odd.withColumn("_name", name_key(F.col("_text")))
    known = plain.select("_column", F.col("_key").alias("_text")).distinct().withColumn("_name", name_key(F.col("_text")))
    known = known.join(small(named.select("_column", "_name").distinct()), ["_column", "_name"], "left_semi")
    alike = known.withColumn("_odd", F.lit(False)).unionByName(named.withColumn("_odd", F.lit(True)))
    keys = alike.groupBy("_column", "_name").agg(F.min(F.struct("_odd", "_text")).alias("_least"))
    keys = pin(named.join(keys, ["_column", "_name"]).select("_column", "_text", F.col("_least._text").alias("_key")))
    return plain.unionByName(other.drop("_key").join(small(keys), ["_column", "_text"]).select(*marked.columns))


def _clashing(rows: DataFrame, unique: list[str], stored: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """(_id, _name) for each text that several rows have, by a number of the text and column, without the rows that have
    a stored text; and those rows (_id)."""
    texts = _texts(rows, unique, F.col("_id"))
    if stored is not None:
        texts = texts.unionByName(_texts(stored, unique, F.lit(None).cast("bigint")))
    keys = keyed(texts)
    own, held = keys.filter("_id IS NOT NULL"), keys.filter("_id IS NULL")
    if stored is not None and has_at_most(rows, SMALL_ROWS):
        # A batch is small next to the stored rows, which then need no shuffle.
        asked = own.select("_column", "_key").distinct()
        keys = own.unionByName(held.join(F.broadcast(asked), ["_column", "_key"], "left_semi"))
    names = keys.groupBy("_column", "_key").agg(
        F.count("_id").alias("_many"), F.min("_id").alias("_least"), F.max(F.col("_id").isNull()).alias("_stored")
    )
    names = names.filter("_many > 1 OR (_many > 0 AND _stored)")
    name = (F.col("_least") * len(unique) + F.col("_column")).alias("_name")
    claims = pin(own.join(names, ["_column", "_key"]).select("_id", name, "_stored"))
    if stored is None:
        return claims.drop("_stored"), []
    barred = pin(claims.filter("_stored").select("_id").distinct())
    if has_at_most(barred, 0):
        return claims.drop("_stored"), []
    return pin(claims.join(barred, "_id", "left_anti").drop("_stored")), [barred]


def _settled(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows refused by a round of accepting first claims, and the claims that are still open."""
    first = claims.groupBy("_name").agg(F.min("_id").alias("_first"))
    held = claims.join(first, "_name")
    chosen = held.groupBy("_id").agg(F.min(F.expr("_id = _first")).alias("_wins")).filter("_wins")
    # The claims on names that a chosen row takes, its own among them.
    hit = held.join(chosen.select(F.col("_id").alias("_first")), "_first", "left_semi")
    out = pin(hit.groupBy("_id").agg(F.max(F.expr("_id <> _first")).alias("_lost")))
    return out.filter("_lost").select("_id"), pin(claims.join(out, "_id", "left_anti"))


def _refused(claims: DataFrame, partitions: int | None) -> DataFrame:
    """(_id) of the rows refused when each component goes through its rows in order of arrival."""
    dealt = claims.coalesce(1) if partitions == 1 else claims.repartition("_component")
    by_row = dealt.groupBy("_component", "_id").agg(F.collect_list("_name").alias("_names"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, taken = None, set()
        for batch in batches:
            lost = []
            for of, row, names in zip(batch["_component"], batch["_id"], batch["_names"]):
                if of != component:
                    component, taken = of, set()
                names = names.tolist()
                if taken.isdisjoint(names):
                    taken.update(names)
                else:
                    lost.append(row)
            yield pd.DataFrame({"_id": lost}, dtype="int64")

    ordered = by_row.sortWithinPartitions("_component", "_id").select("_component", "_id", "_names")
    return pin(ordered.mapInPandas(go, "_id long"))


def components(claims: DataFrame) -> DataFrame:
    """(_id, _component) of the rows in ``claims`` (_id, _name): rows that share a name, directly or by others, share one.

    Each round every component takes over the smallest label that it shares a name with, and pointers to
    labels are followed to their end by doubling. A component that can grow at least doubles, so the number of
    rounds grows with the logarithm of the largest one.
    """
    labels = pin(claims.select("_id", F.col("_id").alias("_component")).distinct())
    while True:
        held = claims.join(labels, "_id")
        by_name = held.groupBy("_name").agg(F.min("_component").alias("_low"), F.max("_component").alias("_high"))
        apart = pin(by_name.filter("_low < _high"))
        if apart.isEmpty():
            return labels
        moved = held.join(apart, "_name").groupBy("_component").agg(F.min("_low").alias("_to"))
        moved = pin(moved.filter("_to < _component"))
        while True:  # a label may move to one that moves on itself
            ahead = moved.select(F.col("_component").alias("_to"), F.col("_to").alias("_further"))
            moved = pin(moved.join(ahead, "_to", "left").select("_component", F.coalesce("_further", "_to").alias("_to"), F.col("_further").isNotNull().alias("_on")))
            if moved.filter("_on").isEmpty():
                break
            moved = moved.drop("_on")
        labels = pin(
            labels.join(moved.drop("_on"), "_component", "left").select("_id", F.coalesce("_to", "_component").alias("_component"))
        )
