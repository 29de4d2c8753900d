"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Blocks sorted by (64-bit key, content) get integer names: the key,
and the position among different contents that share the key (0 unless two contents collide). Adjacent
names are paired and the pairs named in the same way, until one name per document is left. Two documents of
equal length have the same name exactly if their texts are equal, whatever the keys collide on.

The main path holds DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.llm.common import pinned, text_or_empty

BLOCK_BYTES = 4096
_DOC = ["_row", "doc_id", "_bytes", "text_sha256"]


def _key(bits: int, *columns: Column) -> Column:
    value = F.xxhash64(*columns)
    return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))


def _ranks(distinct: DataFrame, content: list[str]) -> DataFrame | None:
    """Positions within each key that more than one content has; None if there is no such key."""
    shared = distinct.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    if shared.isEmpty():
        return None
    order = Window.partitionBy("_key").orderBy(*content)
    ranked = distinct.join(shared, "_key", "left_semi")
    return pinned(ranked.withColumn("_rank", (F.row_number().over(order) - 1).cast("int")))


def _named(rows: DataFrame, distinct: DataFrame, content: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, and without their content."""
    ranks = _ranks(distinct, content)
    if ranks is None:
        out = rows.withColumn("_rank", F.lit(0))
    else:
        names = {c: f"_of{c}" for c in ["_key", *content]}
        ranks = ranks.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_rank").alias("_place"))
        match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
        out = rows.join(ranks, match, "left").withColumn("_rank", F.coalesce("_place", F.lit(0)))
        out = out.drop("_place", *names.values())
    return out.drop(*content)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256, and the identity (_bytes, _key, _rank) with a row id.

    A null text counts as empty. An empty text is one empty block. Other columns are not read. ``key_bits``
    below 64 makes keys collide, which changes names but not which of them are equal.
    """
    size = F.octet_length("_text")
    count = F.greatest(F.lit(1), F.ceil(size / block_bytes)).cast("int")
    cut = docs.select("doc_id", text_or_empty().alias("_text")).select(
        "doc_id",
        size.cast("long").alias("_bytes"),
        F.sha2("_text", 256).alias("text_sha256"),
        count.alias("_n"),
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.substring(F.col("_text").cast("binary"), i * block_bytes + 1, F.lit(block_bytes)),
        ).alias("_blocks"),
    )
    key = _key(key_bits, F.col("_block")).alias("_key")
    distinct = cut.select(F.explode("_blocks").alias("_block")).select(key, "_block").distinct()
    rows = (
        cut.withColumn("_row", F.monotonically_increasing_id())
        .select(*_DOC, "_n", F.posexplode("_blocks").alias("_at", "_block"))
        .select(*_DOC, "_n", "_at", key, "_block")
    )
    level, done = pinned(_named(rows, distinct, ["_block"])), []
    pair = ["_left", "_left_rank", "_right", "_right_rank"]
    while True:  # as often as the longest text's block count can be halved
        done.append(level.filter("_n = 1").select(*_DOC, "_key", "_rank"))
        rest = level.filter("_n > 1")
        if rest.isEmpty():
            break
        even = F.col("_at") % 2 == 0
        pairs = (
            rest.groupBy(*_DOC, "_n", F.floor(F.col("_at") / 2).cast("int").alias("_half"))
            .agg(
                F.max(F.when(even, F.col("_key"))).alias("_left"),
                F.max(F.when(even, F.col("_rank"))).alias("_left_rank"),
                F.max(F.when(~even, F.col("_key"))).alias("_right"),
                F.max(F.when(~even, F.col("_rank"))).alias("_right_rank"),
            )
            .select(
                *_DOC,
                F.ceil(F.col("_n") / 2).cast("int").alias("_n"),
                F.col("_half").alias("_at"),
                _key(key_bits, *[F.col(c) for c in pair]).alias("_key"),
                *pair,
            )
        )
        pairs = pinned(pairs)
        level = pinned(_named(pairs, pairs.select("_key", *pair).distinct(), pair))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of equal texts the row with the largest doc_id stays (null ids rank lowest); if several rows share that
    doc_id, one of them stays. Null text equals empty text. An empty table gives no rows. Groups are counted
    before the shuffle, and the join back has one row per group on one side, so a large group is split at
    run time.
    """
    named = pinned(identities(docs, block_bytes, key_bits))
    name = ["_bytes", "_key", "_rank"]
    groups = pinned(
        named.groupBy(*name).agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    )
    return named.join(groups, name).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )
