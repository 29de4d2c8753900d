"""Helpers shared by the corpus operators: shared folder, row numbers, word pattern."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiffin.session import shared_dir

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; later plans read those files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``pinned``, as Parquet files: later plans know their real size, and read the columns they need."""
    folder = new_folder(df.sparkSession, "written")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 32 << 20) -> None:
    """Send rows to Python in batches of so many rows and bytes at most (or one row), whatever the session had set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: Bits of a bitmap of hashes: 1 MB, whatever the number of values.
BITMAP_BITS = 1 << 23


def maybe_in(values: DataFrame):
    """A function from a long column to whether its value may be in ``values`` (one long column, no nulls).

    It looks at a bitmap of fixed size, set at the hash of each value: never wrong about a value that is in, and
    the more values there are, the more often wrong about others. Nulls are not in.
    """
    spark = values.sparkSession

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))

    bit = values.select(place(F.col(values.columns[0])).alias("_bit"))
    words = bit.groupBy(F.floor(F.col("_bit") / 32).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_bit % 32 AS INT))")).alias("_bits")
    )
    bitmap = np.zeros(BITMAP_BITS // 32, np.uint32)  # no more than 262,144 rows
    for row in words.collect():
        bitmap[row["_word"]] = row["_bits"]
    sent = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def hit(bits: pd.Series) -> pd.Series:
        known = bits.notna().to_numpy()
        at = bits.fillna(0).to_numpy(np.int64)
        return pd.Series(known & ((sent.value[at // 32] >> (at % 32).astype(np.uint32)) & 1).astype(bool))

    return lambda column: hit(F.when(column.isNotNull(), place(column)))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (one column); rows without doc_id stay.

    A bitmap tells most rows that stay from the others where they are read; only rows that hit it are
    shuffled and compared. ``docs`` is read twice.
    """
    ids = pinned(
        ids.select(F.col(ids.columns[0]).cast("long").alias("_without_id")).filter("_without_id IS NOT NULL").distinct()
    )
    marked = docs.withColumn("_without_maybe", maybe_in(ids)(F.col("doc_id").cast("long")))
    stays = marked.filter("NOT _without_maybe").drop("_without_maybe")
    rest = marked.filter("_without_maybe").drop("_without_maybe")
    return stays.unionByName(rest.join(ids, F.col("doc_id").cast("long") == F.col("_without_id"), "left_anti"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(
    df: DataFrame, keys: Sequence[str], spread: Sequence[str], order: Sequence[str], total: int, into: str
) -> DataFrame:
    """Add ``into``: 0, 1, 2, ... per ``keys``, without gaps, however many rows a key has.

    Rows of a key are dealt to hash buckets of ``spread`` (about 5,000 rows each, ``total`` being the
    number of rows of ``df``); a window numbers the rows of a bucket and a running sum over the bucket
    counts gives each bucket its start. ``df`` is read twice and has to be pinned or a file scan.
    """
    buckets = max(1, -(-total // 5_000))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    sums = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .select(
            *[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)],
            F.col("_bucket").alias("_start_bucket"),
            F.coalesce(F.sum("_rows").over(sums), F.lit(0)).alias("_start"),
        )
    )
    same = F.col("_bucket") == F.col("_start_bucket")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{n}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        dealt.join(starts, same)
        .withColumn(into, (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bucket", "_start_bucket", "_start", *[f"_key{n}" for n in range(len(keys))])
    )
