"""Capped water-filling against clamping round by round, and the fill of each source."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import connect, differences
from tiffin.llm.mixing import mix, repeated, source_targets
from tiffin.llm.queries import LLM_ORACLES, LLM_QUERIES


def by_rounds(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Targets by name: share the total by weight, clamp what is above, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, clamped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in clamped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= epochs * sizes[s]]
        if not over:
            return clamped | {s: weight[s] * level for s in free}
        for s in over:
            clamped[s] = epochs * sizes[s]
            left -= clamped[s]


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.text("abcXYZ", min_size=1, max_size=3), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    made = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in source_targets(made).collect()}
    assert found == pytest.approx(by_rounds(sizes))


ROWS = [
    (1, "a b c", None, "s1"), (2, "a", None, "s1"), (3, "one two three four " * 9, None, "s2"), (4, None, None, "s2"),
    (5, "", None, None), (6, "x y", None, None), (7, "x y", None, None), (8, "z", None, "s3"), (8, "z", None, "s3"),
    (None, "q r s", None, "s3"), *[(i, "w " * (i % 7), None, "big") for i in range(20, 80)],
]


def test_taken_words(documents):
    out = mix(documents(*ROWS, extra="size taken _key")).collect()
    words = {(i, t, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, s in ROWS}
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, words[i, t, s]) for i, t, _, s in ROWS)
    sizes = Counter()
    for i, t, _, s in ROWS:
        sizes[s] += words[i, t, s]
    targets = by_rounds(sizes)
    for source in sizes:
        own = [r for r in out if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(targets[source]) for r in own)
        assert abs(sum(r.taken for r in own) - targets[source]) <= 0.5
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    again = mix(documents(*reversed(ROWS))).collect()
    assert Counter(out) == Counter(again)


def test_repeated_rows_keep_their_columns(documents):
    docs = documents(*ROWS, extra="_mix_x taken")
    out = repeated(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mix(docs).collect():
        taken[r.doc_id] += r.taken
    for doc_id, n in Counter(r.doc_id for r in out.collect()).items():
        assert taken[doc_id] > 0 and n >= 1


def test_no_rows(documents):
    assert mix(documents().limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_targets_of_all_documents(spark, folder):
    out = LLM_QUERIES["op6_mixing"](spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sizes, taken, targets = Counter(), Counter(), {}
    for r in out:
        source = docs[r.doc_id].source
        sizes[source] += r.size
        taken[source] += r.taken
        targets[source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert targets == pytest.approx(by_rounds(sizes))
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = LLM_QUERIES["op6_mixing"](spark, folder)
    assert differences(found, connect(folder), LLM_ORACLES["op6_mixing"]) == []
