"""Spelling variants against comparing every pair of words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tiffin.llm import spelling
from tiffin.llm.queries import LLM_QUERIES
from tiffin.llm.spelling import grouped_spellings, variants, word_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, damage=97):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    out.pop("", None)
    return dict(out)


def edits(word):
    """What is left of a word without one code point, marked with the place, and without any mark."""
    return {(n, word[:n] + word[n + 1 :]) for n in range(len(word))}


def near(a, b):
    if len(a) == len(b):
        return a != b and bool(edits(a) & edits(b))
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(rest == short for _, rest in edits(long))


def expected(words, pairs=None):
    by = {w: [] for w in words}
    listed = sorted(words)
    for n, a in enumerate(listed):
        for b in listed[n + 1 :] if pairs is None else pairs(a):
            if near(a, b):
                by[a].append(b)
                by[b].append(a)
    form = {}
    for word, others in by.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[word] = best if best is not None and words[best] >= 2 * words[word] else None
    out = {}
    for word in words:
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (words[word], len(by[word]), form[word], words.get(form[word]), root)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=9), st.integers(1, 99), max_size=60), st.integers(2, 4096))
def test_near_words(spark, words, block):
    made = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(variants(made, block=block)) == expected(words)


def test_words_of_far_code_points(make):
    words = {"abcde": 9, "abcd\U00010348": 4, "ābcde": 4, "bcde": 2, "漢字漢字漢": 5, "漢字漢字": 1}
    assert found(variants(make("word string, n long", *words.items()))) == expected(words)


def test_hot_bucket_in_blocks(spark, rng):
    words = {"same" + "".join(rng.choices("abcdef", k=5)) + "ending": rng.randrange(1, 50) for _ in range(1500)}
    made = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(variants(made, block=200, range_rows=500)) == expected(words)


def test_long_chain_of_forms(make):
    words = {"a" * 5 + "bcdefghijkl"[:n]: 2**n for n in range(11)}
    out = found(variants(make("word string, n long", *words.items())))
    assert out == expected(words) and out["aaaaa"][-1] == "aaaaabcdefghijk"


def test_damaged_runs(documents, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rows = [(n, "Die ÄPFEL, wörter; naïve×words÷more O'Neil über-all " + "lang" * n) for n in range(300)]
    rows += [(None, "Words without an id"), (7, None), (8, ""), (9, "12 34"), (7, rows[7][1]), (301, "x" * 100_000 + " a b c")]
    got = {r.word: r.n for r in word_counts(documents(*rows, extra="word n _id")).collect()}
    assert got == counts(rows)


def test_no_rows(documents):
    assert grouped_spellings(documents().limit(0)).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_on_all_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    words = {w: n for w, n in counts(rows).items() if len(w) >= 5 and n >= 3}
    # Only words that share what is left without one code point can be near.
    left = {}
    for word in words:
        for rest in {word} | {rest for _, rest in edits(word)}:
            left.setdefault(rest, set()).add(word)

    def others(word):
        return {o for rest in {word} | {r for _, r in edits(word)} for o in left[rest] if o > word}

    assert found(LLM_QUERIES["op13_spelling_variants"](spark, folder)) == expected(words, others)
