"""Contaminated documents against comparing every window with every item."""

import re
from collections import Counter

import numpy as np

from tests.llm.conftest import prose
from tiffin.llm import decontam
from tiffin.llm.decontam import RADIUS, Items, decontaminated, matches
from tiffin.llm.queries import LLM_QUERIES


def grams(words, size=5):
    words = list(words)
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def alike(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def expected(rows, items, threshold=0.8):
    out = {}
    for doc_id, text in rows:
        words = words_of(text)
        for item_id, item in items:
            wanted = words_of(item)
            if not wanted or not words:
                continue
            n = len(wanted)
            if n >= 5 and not grams(words).keys() & grams(wanted).keys():
                continue  # no window shares anything
            spans = [words[i : i + n] for i in range(len(words) - n + 1)] or [words]
            best = max(alike(grams(s), grams(wanted)) for s in spans)
            if best >= threshold:
                out[doc_id, item_id] = round(best, 9)
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def fixture(rng):
    items = [(n, prose(rng, rng.randrange(20, 60), 5000)) for n in range(12)]
    items += [(20, "three little words"), (21, None), (22, ""), (23, items[0][1]), (24, "Twice upon, a TIME. " * 6)]
    rows = []
    for n in range(80):
        item = rng.choice(items[:12])[1].split()
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "changed"
        place = rng.choice([item, item[: len(item) // 2], [], item + item])
        rows.append((n, f"{prose(rng, rng.randrange(30), 5000)} {', '.join(place)}. {prose(rng, rng.randrange(30), 5000)}"))
    rows += [(100, None), (101, ""), (102, "Three little WORDS"), (103, "so three little words here"), (104, items[1][1].upper())]
    rows += [(105, "Twice upon, a TIME. " * 9), (106, "twice upon"), (107, prose(rng, 40_000, 5000))]
    return rows, items


def test_equals_all_windows(spark, documents, rng):
    """Pairs within the radius are found; at 0.8 a few fingerprints differ in more bits, so those are told apart."""
    rows, items = fixture(rng)
    want = expected(rows, items)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in matches(documents(*rows), benchmark(spark, items)).collect()}
    assert set(got) <= set(want)
    assert all(got[k] <= want[k] for k in got)
    missed = {k: v for k, v in want.items() if k not in got}
    assert all(v < 0.9 for v in missed.values()) and len(missed) <= 0.02 * len(want)


def test_blocks_find_all_within_the_radius(rng):
    items = Items(list(range(300)), [prose(rng, 30, 3000) for _ in range(300)], 5)
    for _ in range(300):
        near = int(items.prints[rng.randrange(300)])
        for bit in rng.sample(range(64), rng.randrange(RADIUS + 4)):
            near ^= 1 << bit
        near = np.uint64(near)
        want = np.flatnonzero(np.bitwise_count(items.prints ^ near) <= RADIUS)
        assert items.within(near, RADIUS).tolist() == want.tolist()


def test_items_in_several_passes(spark, documents, rng, monkeypatch):
    rows, items = fixture(rng)
    whole = {tuple(r) for r in matches(documents(*rows), benchmark(spark, items)).collect()}
    monkeypatch.setattr(decontam, "PASS_ITEMS", 5)
    assert {tuple(r) for r in matches(documents(*rows), benchmark(spark, items)).collect()} == whole


def test_removal_and_no_rows(spark, documents):
    items = benchmark(spark, [(1, "one two three four five six seven")])
    docs = documents((1, "one two three four five six seven"), (2, "else"), (3, None), (None, "x"), extra="_id similarity")
    out = decontaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 3, None]
    assert matches(docs.limit(0), items).count() == 0
    assert matches(docs, items.limit(0)).count() == 0


def test_items_without_id(spark, documents):
    text, big = "one two three four five six seven", 2**53 + 1
    items = benchmark(spark, [(None, text), (None, "short one"), (big, text), (3, "not here at all, not anywhere")])
    docs = documents((1, f"so {text} here"), (2, "a short one"), (3, "else"))
    got = sorted(((r.doc_id, r.item_id, r.window_start) for r in matches(docs, items).collect()), key=str)
    assert got == sorted([(1, None, 1), (1, big, 1), (2, None, 1)], key=str)
    assert [r.doc_id for r in decontaminated(docs, items).collect()] == [3]


def test_query_finds_all_verbatim_items(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in LLM_QUERIES["op10_decontamination"](spark, folder).collect()}
    assert {(i, k) for i, t in docs for k, item in items if item in t} <= got
    assert got <= set(expected([d for d in docs if d[0] in {i for i, _ in got}], items))


def test_ids_beside_a_null_id_stay_exact(spark, documents, rng):
    item = prose(rng, 30, 5000)
    rows = [(9007199254740993, item), (None, item), (9007199254740993, item + " more"), (3, "nothing")]
    out = matches(documents(*rows), benchmark(spark, [(9007199254740995, item), (None, item)])).collect()
    assert Counter((r.doc_id, r.item_id) for r in out) == Counter(
        (i, item_id) for i in (9007199254740993, None, 9007199254740993) for item_id in (9007199254740995, None)
    )
