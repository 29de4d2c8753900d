"""Hard negatives against scoring every pair, and Strassen's recursion against the plain product."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import connect, differences
from tiffin.llm import negatives
from tiffin.llm.negatives import hard_negatives, product
from tiffin.llm.queries import LLM_ORACLES, LLM_QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.sampled_from([3, 2**20, 2**31]))
def test_product(seed, rows, inner, columns, most):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-most, most, (rows, inner)), rng.integers(-most, most, (inner, columns))
    assert (product(a, b) == a @ b).all()


def expected(rows):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = Counter()
    for n, (anchor, label, vector) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), vec_id is None, vec_id or 0, of, vec_id)
            for m, (vec_id, of, other) in enumerate(kept)
            if m != n
        ]
        scored.sort(key=lambda row: row[:3])
        for minus, _, _, _, positive in [row for row in scored if row[3] == label][:5]:
            score = -minus
            inside = [row for row in scored if row[3] != label and 80 * score <= -100 * row[0] <= 100 * score][:5]
            for rank, row in enumerate(inside, 1):
                out[anchor, positive, rank, row[4], score, -row[0]] += 1
    return out


def found(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(df.dtypes) == dict.fromkeys(names, "bigint") | {"rank": "int"}
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def vectors(seed, many, wide=8, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    made = rng.normal(0, spread, (many, wide)).astype(np.float32)
    return [(n * 20, made[n].tolist(), int(rng.integers(labels))) for n in range(many)]


def odd():
    rows = vectors(1, 150) + vectors(2, 20)  # repeated ids
    rows += rows[:30]  # and repeated rows
    rows += [(100, [0.5] * 8, 3)] * 3 + [(200, [0.25] * 3, 3), (300, [], 1), (400, None, 1), (500, [1.0] * 8, None)]
    rows += [(600, [float("nan")] * 8, 1), (700, [float("inf")] + [0.0] * 7, 1), (800, [None, 1.0], 1), (None, [0.5] * 8, 2)]
    rows += [(None, [0.6] * 8, 3), (9007199254740900, [0.4] * 8, 3), (9007199254740993, [0.4] * 8, 2), (-100, [-1.0] * 8, 0)]
    return rows


def test_odd_rows(make):
    rows = odd()
    docs = make(SCHEMA, *rows).selectExpr("*", "'x' AS anchor", "'y' AS rank", "1 AS data")
    assert found(hard_negatives(docs)) == expected(rows)


def test_several_blocks_and_tiles(make, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 5)
    monkeypatch.setattr(negatives, "GROUP_ROWS", 40)
    monkeypatch.setattr(negatives, "PART", 7)
    rows = odd()
    assert found(hard_negatives(make(SCHEMA, *rows).repartition(9))) == expected(rows)


def test_ties_go_to_smaller_ids(make):
    rows = [(n, [1.0, 0.0], n % 2) for n in range(1, 400) if n % 7] + [(700, [1.0, 0.0], 0)]
    assert found(hard_negatives(make(SCHEMA, *rows).repartition(3))) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]])
def test_few_rows(make, rows):
    assert found(hard_negatives(make(SCHEMA, *rows))) == Counter()


def test_numbers_beyond_the_range_fail(make):
    with pytest.raises(Exception, match="beyond 31 bits"):
        hard_negatives(make(SCHEMA, (100, [1e9], 1))).collect()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_equals_sql(spark, folder):
    out = LLM_QUERIES["op11_hard_negatives"](spark, folder)
    assert differences(out, connect(folder), LLM_ORACLES["op11_hard_negatives"]) == [] and out.count()
