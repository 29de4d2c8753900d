"""Run registered queries in Spark and their SQL twins in DuckDB and compare rows.

``python -m tests.compare [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TIFFIN_TESTDATA", "/root/testdata/sf0.01")


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        elif not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return value


KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def kind(spark_type: str) -> str:
    return KINDS.get(spark_type.split(" collate")[0], spark_type)


def differences(df, con, sql: str) -> list[str]:
    """What differs in names, types or rows; empty if equal."""
    rel = con.sql(sql)
    spark_types = {name: kind(t) for name, t in df.dtypes}
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    found = []
    if set(spark_types) != set(duck_types):
        return [f"columns {sorted(spark_types)} != {sorted(duck_types)}"]
    for name, t in spark_types.items():
        if t != duck_types[name]:
            found.append(f"type of {name}: {t} != {duck_types[name]}")
    names = sorted(spark_types)
    left = Counter(tuple(plain(row[n]) for n in names) for row in df.collect())
    order = [rel.columns.index(n) for n in names]
    right = Counter(tuple(plain(row[i]) for i in order) for row in rel.fetchall())
    if left != right:
        only_left, only_right = left - right, right - left
        found.append(
            f"rows {sum(left.values())} vs {sum(right.values())}; {names}; "
            f"only spark {list(only_left)[:3]}; only sql {list(only_right)[:3]}"
        )
    return found


def main(names: list[str]) -> int:
    from tiffin.plans.oracles import ORACLES
    from tiffin.plans.queries import QUERIES
    from tiffin.session import local_session

    spark = local_session(8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tiffin-compare-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect()
    bad = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, DATA)
            found = differences(df, con, ORACLES[name]) if name in ORACLES else [f"no sql, rows {df.count()}"]
        except Exception as error:  # report and go on
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{name}: {'ok' if not found else found} {time.time() - start:.2f}s", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
