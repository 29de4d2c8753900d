"""Access-log lines: ``[LEVEL] METHOD path - status - Nms``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.functions.domains import ACCESS_LOG_PATTERN


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_log(spark.read.text(path))


def parse_access_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds level, method, path, status and duration; other lines are left out."""
    parts = {
        name: F.regexp_extract(column, ACCESS_LOG_PATTERN, group)
        for group, name in enumerate(["level", "method", "path", "status", "duration_ms"], 1)
    }
    typed = parts | {name: parts[name].cast("int") for name in ("status", "duration_ms")}
    return lines.filter(F.col(column).rlike(ACCESS_LOG_PATTERN)).withColumns(typed).drop(column)


def access_log_line(level, method, path, status, duration_ms):
    """The log line of a served request."""
    return F.format_string("[%s] %s %s - %d - %dms", level, method, path, status, duration_ms)
