"""The Jaccard join against all pairs, and union-find against a plain one."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tiffin.llm import cells, jaccard
from tiffin.llm.common import without_ids
from tiffin.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


class Union(dict):
    def find(self, a):
        self.setdefault(a, a)
        while self[a] != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def expected(rows, size, percent):
    """Of rows with different ids."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    union, ids = Union(), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_all_links_between_edited_copies(documents, rng, size, percent):
    rows, base = [], [prose(rng, n) for n in (3, 12, 60, 150, 151)]
    for n in range(400):
        rows.append((n, edited(rng, rng.choice(base), rng.randrange(6))))
    rows += [(n, prose(rng, rng.randrange(1, 80))) for n in range(400, 500)]
    assert found(jaccard.similar_groups(documents(*rows), size, percent)) == expected(rows, size, percent)


def test_links_inside_a_component(documents, rng):
    """Every link of a group of near copies, and its number of links with copies counted."""
    base = prose(rng, 60)
    texts = [edited(rng, base, rng.randrange(3)) for _ in range(40)]
    rows = [(n, texts[n % 40]) for n in range(70)] + [(n, prose(rng, 20)) for n in range(70, 80)]
    sets = {i: shingle_set(t, 3) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    docs = documents(*rows, (100, None))
    out = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.linked_groups(docs, 3, 80).collect()}
    want = {i: (*own, sum(i in p for p in pairs)) for i, own in expected(rows, 3, 80).items()}
    assert out == want | {100: (0, 100, 0)}
    first = {own: i for i, own in reversed(sets.items())}
    wanted = {frozenset((first[sets[a]], first[sets[b]])) for a, b in pairs if sets[a] != sets[b]}
    got = [frozenset(r) for r in jaccard.class_links(docs, 3, 80).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 100


@pytest.mark.parametrize("rows", [1_024, 30])
def test_near_copies_make_few_pairs(documents, rng, monkeypatch, rows):
    """The rows of a join of near copies don't grow with their square, in one tile or several."""
    base, own, made = prose(rng, 80), jaccard.pinned, []
    texts = [edited(rng, base, 1) for _ in range(120)]

    def counted(df):
        out = own(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "pinned", counted)
    monkeypatch.setattr(cells, "TILE_ROWS", rows)
    out = {r.doc_id: r.n_links for r in jaccard.linked_groups(documents(*enumerate(texts)), 3, 80).collect()}
    sets = [shingle_set(t, 3) for t in texts]
    want = [sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets]
    assert out == dict(enumerate(want)) and sum(want) > 120 * 60
    assert max(made) < 4 * 120


def test_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(jaccard.similar_groups(docs, 3, 90)) == expected(rows, 3, 90)


def test_odd_rows(documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = documents(
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (9, long + " end"),
        (10, "É a b"), (11, "é a b"), (11, "é a b"), (None, "one"), (None, "alone here now"), extra="node size shared",
    )
    out = sorted(map(tuple, jaccard.similar_groups(docs, 3, 90).collect()), key=str)
    assert out == sorted(
        [
            (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29_998, 7), (9, 29_999, 7),
            (10, 1, 10), (11, 1, 11), (11, 1, 11), (None, 1, 4), (None, 1, None),
        ],
        key=str,
    )
    kept = jaccard.one_per_group(docs, 3, 90)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 6, 7, 10, 11, 11]


def test_no_rows(documents):
    assert jaccard.similar_groups(documents().limit(0)).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    union = Union()
    for a, b in edges:
        union.join(a, b)
    links = spark.createDataFrame(edges, "a long, b long")
    want = {x: union.find(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in components(links).collect()} == want


def test_long_chain(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components(links).collect()} == {0}


def test_without_ids(documents, spark):
    docs = documents(*[(i, str(i)) for i in range(50)], (None, "x"))
    ids = spark.range(0, 50, 3)
    kept = [r.doc_id for r in without_ids(docs, ids).collect()]
    assert sorted(kept, key=str) == sorted([i for i in range(50) if i % 3] + [None], key=str)
