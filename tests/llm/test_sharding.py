"""Minimax contiguous shards against trying all cuts, and the law of the query."""

import itertools
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tiffin.llm.queries import LLM_QUERIES
from tiffin.llm.sharding import Runs, minimax_shards

SIZES = st.lists(st.integers(1, 40), min_size=1, max_size=9)


def as_runs(sizes):
    ordered = sorted(sizes, reverse=True)
    return Runs([(size, len(list(same))) for size, same in itertools.groupby(ordered)]), ordered


@settings(max_examples=200, deadline=None)
@given(SIZES, st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    runs, ordered = as_runs(sizes)
    best = min(
        max(sum(ordered[a:b]) for a, b in itertools.pairwise((0, *cut, len(ordered))))
        for cut in itertools.combinations_with_replacement(range(len(ordered) + 1), shards - 1)
    )
    assert runs.smallest(0, 0, shards) == best


@settings(max_examples=200, deadline=None)
@given(SIZES, st.integers(1, 5))
def test_cuts_keep_the_capacity(sizes, shards):
    runs, ordered = as_runs(sizes)
    cuts = runs.cuts(shards)
    at = [ordered.index(size) + offset for size, offset in cuts]
    assert at == sorted(at) and len(cuts) < shards
    loads = [sum(ordered[a:b]) for a, b in itertools.pairwise((0, *at, len(ordered)))]
    assert max(loads) == runs.smallest(0, 0, shards)


def check(rows, out, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    texts = dict(rows)
    places = {}
    for r in out:
        assert 0 <= r.shard < shards
        places.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    for shard in range(shards):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_rows_slots_and_groups(documents):
    rows = [(1, "a" * 50), (2, None), (3, ""), (4, "b"), (5, "b"), (6, "é" * 10), *[(i, f"t{i}") for i in range(10, 60)]]
    rows += [(i, "the same text") for i in range(100, 200)]  # one group of most of the bytes
    out = minimax_shards(documents(*rows, extra="shard _weight _rows"), 4).collect()
    check(rows, out, 4)
    loads = sorted(sum(r.size for r in out if r.shard == s) for s in range(4))
    assert loads[3] == 1400 and loads[2] - loads[0] < 51  # the large group alone, the rest near equal


def test_few_groups_and_no_rows(documents):
    assert minimax_shards(documents().limit(0), 3).count() == 0
    assert {r.shard for r in minimax_shards(documents((1, "a"), (1, "a")), 3).collect()} == {0}


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    out = LLM_QUERIES["op5_sharding"](spark, folder).collect()
    check(rows, out, 16)
    loads = [sum(r.size for r in out if r.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 33_048  # the longest text
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
