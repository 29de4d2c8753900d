"""Versioned tables on plain Parquet.

``publish`` writes every table of a change into one version folder and then adds
one row per table to the version log. Readers resolve the log once, so they see all
tables of a version or none. Every attempt has a folder of its own and the last one logged
counts: a replayed batch gives the same state, and readers keep the files they opened.

A table published in buckets of its key has one log row per bucket, and a version writes only those it
changes: readers take the newest of each, as many folders as there are buckets at most.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG_SCHEMA = "version BIGINT, table STRING, path STRING, attempt BIGINT, bucket INT, kind STRING"
#: Buckets of a table that is published in buckets.
BUCKETS = 64


class Buckets(NamedTuple):
    """All rows of the buckets ``touched`` of a table (None: of all of its ``count`` buckets of ``key``)."""

    rows: DataFrame
    key: str
    touched: list[int] | None = None
    count: int = BUCKETS


def bucket_of(key: str, count: int = BUCKETS) -> Column:
    """The bucket of a row; the key's type doesn't matter, only how it is written."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(count)).cast("int")


def touched(rows: DataFrame, key: str, count: int = BUCKETS) -> list[int]:
    """The buckets that have ``rows``, at most ``count``."""
    return sorted(row[0] for row in rows.select(bucket_of(key, count)).distinct().collect())


def _log(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG_SCHEMA).json(f"{folder}/_versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def table_paths(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, str]:
    """Newest published folder of each table, at most one small row per table."""
    log = _log(spark, folder)
    if log is None:
        return {}
    if version is not None:
        log = log.filter(F.col("version") <= version)
    newest = log.filter("bucket IS NULL").groupBy("table").agg(F.max_by("path", F.struct("version", "attempt")).alias("path"))
    return {row["table"]: row["path"] for row in newest.collect()}


def latest_version(spark: SparkSession, folder: str) -> int | None:
    log = _log(spark, folder)
    return None if log is None else log.agg(F.max("version")).first()[0]


def _write_buckets(table: Buckets, path: str) -> dict[int, str | None]:
    """Write the rows below ``path``; the folder of each touched bucket, None where it has no rows left."""
    rows = table.rows.withColumn("_bucket", bucket_of(table.key, table.count))
    # A small bucket becomes one file, a large one several.
    rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
    written = table.rows.sparkSession.read.schema(rows.schema).parquet(path).select("_bucket").distinct().collect()
    filled = {row[0] for row in written}
    return {
        n: f"{path}/_bucket={n}" if n in filled else None
        for n in (range(table.count) if table.touched is None else table.touched)
    }


def publish(tables: dict[str, DataFrame | Buckets], folder: str, version: int) -> None:
    """Write the tables as one version and switch readers to it. ``Buckets`` replace only the buckets they touch."""
    first = next(iter(tables.values()))
    spark = (first.rows if isinstance(first, Buckets) else first).sparkSession
    newest = latest_version(spark, folder)
    if newest is not None and newest > version:
        raise ValueError(f"version {version} is older than the published version {newest}")
    attempt, run = 0, uuid.uuid4().hex
    if newest == version:
        same = _log(spark, folder).filter(F.col("version") == version)
        attempt = same.agg(F.max("attempt")).first()[0] + 1
    rows = []
    for name, df in tables.items():
        path = f"{folder}/v={version}/{run}/{name}"
        if isinstance(df, Buckets):
            kind = df.rows.schema.json()
            rows += [(version, name, place, attempt, n, kind) for n, place in _write_buckets(df, path).items()]
        else:
            df.write.parquet(path)
            rows.append((version, name, path, attempt, None, None))
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/_versions")


def current(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame | None:
    """The table as last published (up to ``version``), or None."""
    path = table_paths(spark, folder, version).get(table)
    return in_buckets(spark, folder, table, version) if path is None else spark.read.parquet(path)


def in_buckets(
    spark: SparkSession, folder: str, table: str, version: int | None = None, only: list[int] | None = None
) -> DataFrame | None:
    """The table as last published in buckets (up to ``version``), all or ``only`` some of them; None if it never was."""
    log = _log(spark, folder)
    if log is None:
        return None
    log = log.filter((F.col("table") == table) & F.col("bucket").isNotNull())
    if version is not None:
        log = log.filter(F.col("version") <= version)
    last = F.max_by(F.struct("path", "kind"), F.struct("version", "attempt")).alias("last")
    newest = {row["bucket"]: row["last"] for row in log.groupBy("bucket").agg(last).collect()}
    if not newest:
        return None
    schema = StructType.fromJson(json.loads(next(iter(newest.values()))["kind"]))
    paths = [row["path"] for n, row in newest.items() if row["path"] and (only is None or n in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def all_versions(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of every published version of a table, for outputs written per version."""
    log = _log(spark, folder)
    last = log.filter(F.col("table") == table).groupBy("version").agg(F.max_by("path", "attempt").alias("path"))
    # One short path per version.
    paths = [row["path"] for row in last.collect()]
    return spark.read.parquet(*paths)


def append_by_day(df: DataFrame, path: str, ts: str = "created_at", day: str = "order_date") -> None:
    """Append rows in one folder per day.

    The rebalance hint merges small days into one file and splits a large one.
    """
    rows = df.withColumn(day, F.to_date(ts)).hint("rebalance", day)
    rows.write.mode("append").partitionBy(day).parquet(path)


def append_lines(lines: DataFrame, path: str, batch_id: int) -> None:
    """Bulk append of order lines; a batch that is sent again replaces its own folder."""
    rows = lines.withColumn("order_date", F.to_date("created_at")).hint("rebalance", "order_date")
    rows.write.mode("overwrite").partitionBy("order_date").parquet(f"{path}/batch={batch_id}")


def newest_rows(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last change row per key; partial maxima are taken before the shuffle."""
    row = F.struct(*changes.columns)
    return (
        changes.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*").select(*changes.columns)
    )


def compact(changes: DataFrame, key: str, order: list[str], folder: str, table: str, version: int) -> None:
    """Fold appended change rows into one published row per key."""
    publish({table: newest_rows(changes, key, order)}, folder, version)
