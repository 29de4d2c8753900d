"""Viterbi against all label sequences, narrowing by script, and accuracy on held-out documents."""

import itertools
import pickle
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from tests.llm.conftest import prose
from tiffin.llm.language import accepted, fit, identify, predict, viterbi, words_of
from tiffin.llm.queries import LLM_QUERIES


def total(scores, labels, switch):
    return sum(row[x] for row, x in zip(scores, labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-9, 0)] * 3), max_size=6), min_size=1, max_size=4), st.integers(0, 9))
def test_best_sequences(texts, switch):
    scores = np.array([row for text in texts for row in text], float).reshape(-1, 3)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    labels = viterbi(scores, offsets, switch)
    for text, a, b in zip(texts, offsets, offsets[1:]):
        best = max(total(text, some, switch) for some in itertools.product(range(3), repeat=len(text)))
        assert total(text, list(labels[a:b]), switch) == best


EN = "the of and that with this from they have would there their which about when what some into could other than then"
RU = "это как его она они был что для при все или если только может быть когда после надо есть время год дело жизнь"


def labelled(rng):
    rows = []
    for n in range(200):
        words, lang = (EN, "en") if n % 2 else (RU, "ru")
        rows.append((n, " ".join(rng.choices(words.split(), k=12)), lang))
    return rows


def test_spans_of_mixed_text(documents, rng):
    model = fit(documents(*labelled(rng)))
    text = f"1. {EN}! {RU}; {EN}?"
    [row] = predict(documents((1, text), extra="score"), model).collect()
    spans = [(s.lang, text[s.begin : s.stop]) for s in row.predicted.spans]
    assert spans == [("en", EN), ("ru", RU), ("en", EN)]
    assert row.predicted.lang_pred == "en" and 0.5 < row.predicted.score < 0.8


def test_odd_rows(documents, rng):
    rows = labelled(rng)
    odd = [(1000, None), (1001, ""), (1002, "12 34 !?"), (1003, "漢字 漢字"), (1003, "漢字 漢字"), (None, EN), (1004, (EN + " ") * 3000)]
    out = identify(documents(*rows, *odd, extra="spans lang_pred predicted")).collect()
    assert len(out) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in out}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[1003].lang_pred in ("en", "ru") and by_id[1003].score == 0  # a script that no language uses
    assert by_id[None].lang_pred == by_id[1004].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)


def test_without_labels_or_rows(documents):
    assert [r.lang_pred for r in identify(documents((1, "some words"))).collect()] == ["und"]
    assert identify(documents().limit(0)).count() == 0
    assert [r.doc_id for r in accepted(documents((1, "words"), (2, "12"), (3, None))).collect()] == [1]


def test_accepted_keeps_columns_and_documents(documents, rng):
    docs = documents(*labelled(rng), (500, "12 34"), (501, None), extra="predicted score")
    out = accepted(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(200))


def test_accepted_by_evidence(documents, rng):
    """Unknown scripts and random letters go; text of several languages stays, with some unknown words too."""
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(40))
    odd = [(500, "漢字 漢字 仮名"), (501, noise), (502, "ελληνικά λόγια"), (503, f"{EN} 漢字漢字漢字 " + noise)]
    good = [(600, f"{EN} {RU}"), (601, EN.upper()), (602, "when they have"), (603, f"{EN} {RU} {noise[:70]} 漢字")]
    out = accepted(documents(*labelled(rng), *odd, *good)).collect()
    assert sorted(r.doc_id for r in out) == [*range(200), *range(600, 604)]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = LLM_QUERIES["op4_language_id"](spark, folder).join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98


def test_more_languages_than_a_byte_holds():
    scores = np.full((300, 300), -50.0)
    scores[np.arange(300), np.arange(300)] = 0.0
    assert list(viterbi(scores, np.arange(301))) == list(range(300))


def test_letters_of_far_planes(documents, rng):
    model = fit(documents(*labelled(rng)))
    out = predict(documents((1, "\U00030001\U00031355"), (2, "\U0001f600")), model).collect()
    assert {r.doc_id: r.predicted.lang_pred == "und" for r in out} == {1: False, 2: True}


def test_tables_of_letters_are_not_sent():
    words_of(["a"])
    assert len(cloudpickle.dumps(words_of)) < 100_000


def test_nothing_of_the_package_is_broadcast(spark, documents, rng, monkeypatch):
    sent, own = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or own(self, value))
    predict(documents((1, EN)), fit(documents(*labelled(rng)))).collect()
    assert sent and all(b"tiffin" not in pickle.dumps(value) for value in sent)


def test_accepted_keeps_columns_of_any_name(documents, rng):
    docs = documents(*labelled(rng), extra="predicted _predicted spans")
    out = accepted(docs)
    assert out.columns == docs.columns and out.count() == 200
