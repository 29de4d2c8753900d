"""Tables published in buckets: what a version writes, and what its readers see."""

from pathlib import Path

from tests.conftest import rows_of
from tiffin.sources import store
from tiffin.sources.store import Buckets, in_buckets, publish, touched

SCHEMA = "key BIGINT, value STRING"


def put(make, folder, version, rows, hit=None):
    publish({"t": Buckets(make(SCHEMA, *rows), "key", hit, 8)}, folder, version)


def written(folder, version):
    return sorted({path.parent.name for path in Path(f"{folder}/v={version}").rglob("_bucket=*/*.parquet")})


def test_only_touched_buckets_are_written(spark, make, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(n, "old") for n in range(40)]
    put(make, folder, 0, rows)
    change = make(SCHEMA, (3, "new"))
    hit = touched(change, "key", 8)
    before = in_buckets(spark, folder, "t", 0, hit)
    assert len(hit) == 1 and 0 < before.count() < 40
    merged = before.join(change.select("key"), "key", "left_anti").unionByName(change)
    publish({"t": Buckets(merged, "key", hit, 8)}, folder, 1)
    assert written(folder, 1) == [f"_bucket={hit[0]}"]
    want = sorted((k, "new" if k == 3 else v) for k, v in rows)
    assert sorted(tuple(r) for r in store.current(spark, folder, "t").collect()) == want
    assert sorted(tuple(r) for r in in_buckets(spark, folder, "t", 0).collect()) == rows


def test_a_bucket_that_loses_all_rows_is_empty(spark, make, tmp_path):
    folder = str(tmp_path / "t")
    put(make, folder, 0, [(n, "x") for n in range(40)])
    hit = touched(make(SCHEMA, (3, "x")), "key", 8)
    put(make, folder, 1, [], hit)
    left = {r.key for r in store.current(spark, folder, "t").collect()}
    assert left and 3 not in left and in_buckets(spark, folder, "t", None, hit).count() == 0


def test_a_replayed_version_counts_once(spark, make, tmp_path):
    folder = str(tmp_path / "t")
    put(make, folder, 0, [(1, "a"), (2, "b")])
    hit = touched(make(SCHEMA, (1, "c")), "key", 8)
    for value in ("lost", "c"):
        rows = [(1, value)] + [(2, "b")] * (touched(make(SCHEMA, (2, "b")), "key", 8) == hit)
        put(make, folder, 1, rows, hit)
    assert rows_of(store.current(spark, folder, "t")) == [(1, "c"), (2, "b")]


def test_no_rows_and_no_table(spark, make, tmp_path):
    folder = str(tmp_path / "t")
    assert in_buckets(spark, folder, "t") is None
    put(make, folder, 0, [(None, "no key")])
    assert rows_of(store.current(spark, folder, "t")) == [(None, "no key")]
    put(make, folder, 1, [])
    assert store.current(spark, folder, "t").columns == ["key", "value"] and store.current(spark, folder, "t").count() == 0
    assert in_buckets(spark, folder, "other") is None


def test_tables_of_both_kinds_are_one_version(spark, make, tmp_path):
    folder = str(tmp_path / "t")
    publish({"whole": make(SCHEMA, (1, "w")), "t": Buckets(make(SCHEMA, (1, "b")), "key", None, 4)}, folder, 0)
    publish({"whole": make(SCHEMA, (2, "w"))}, folder, 1)
    assert rows_of(store.current(spark, folder, "t", 1)) == [(1, "b")]
    assert list(store.table_paths(spark, folder)) == ["whole"]
