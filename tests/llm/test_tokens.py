"""Token totals against counting everything again."""

from collections import Counter

import pytest

from tiffin.llm import queries, tokens
from tiffin.llm.common import new_folder

CHANGE = "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string"


@pytest.fixture
def store(spark):
    return tokens.TokenTotals(spark, new_folder(spark, "totals"))


def apply_all(store, spark, batches):
    for n, rows in batches:
        store.apply(n, spark.createDataFrame(rows, CHANGE))


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_inserts_deletes_and_revisions(store, spark):
    apply_all(
        store,
        spark,
        [
            (1, [(1, "a", "en", "v1", 10, "insert"), (2, "a", "en", "v1", 5, "insert"), (3, "b", None, "v1", 7, "insert")]),
            (2, [(1, "a", "en", "v2", 8, "insert"), (2, "a", "en", "v1", 6, "revise"), (3, "b", None, "v1", None, "delete")]),
            (3, [(1, "b", "en", "v1", 11, "revise"), (9, "b", "en", "v1", 1, "delete"), (4, None, None, "v1", 2, "revise")]),
        ],
    )
    assert totals(store) == {
        ("a", "en", "v1"): (1, 6), ("a", "en", "v2"): (1, 8), ("b", "en", "v1"): (1, 11), (None, None, "v1"): (1, 2),
    }
    assert sum(r.n_tokens for r in store.current().collect()) == 27


def test_a_batch_counts_once(store, spark):
    batch = (1, [(1, "a", "en", "v1", 10, "insert"), (1, "a", "en", "v1", 10, "insert")])
    apply_all(store, spark, [batch, batch, (2, [(1, "a", "en", "v1", 4, "revise")]), batch])
    assert totals(store) == {("a", "en", "v1"): (1, 4)}


def test_a_lost_batch_leaves_nothing(store, spark):
    apply_all(store, spark, [(1, [(1, "a", "en", "v1", 10, "insert")])])
    # What an attempt leaves that was lost before its commit.
    lost = spark.createDataFrame([(1, "a", "en", "v1", 99, False)], tokens.LEDGER)
    lost.write.parquet(f"{store.folder}/ledger/batch=2/attempt=x")
    assert totals(store) == {("a", "en", "v1"): (1, 10)}
    apply_all(store, spark, [(2, [(1, "a", "en", "v1", None, "delete")])])
    assert totals(store) == {}


def test_void_changes_and_no_rows(store, spark):
    apply_all(store, spark, [(1, []), (2, [(None, "a", "en", "v1", 1, "insert"), (1, "a", "en", "v1", 1, None)])])
    assert totals(store) == {}
    assert store.totals().columns == ["source", "lang", "tokenizer", "n_docs", "n_tokens"]


def test_counted(documents):
    docs = documents((1, "a b\tc"), (2, None), (3, ""), (None, "x " * 50_000), extra="n_tokens tokens")
    out = {r.doc_id: r.n_tokens for r in tokens.counted(docs, "words/1", tokens.word_counter).collect()}
    assert out == {1: 3, 2: 0, 3: 0, None: 50_000}


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    count = tokens.bpe_counter(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", queries.BYTE_BPE_PATTERN)()
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want[r.source, r.lang] += count([r.text])[0]
    rows = queries.LLM_QUERIES["op1_token_counts"](spark, folder).collect()
    assert {(r.source, r.lang): r.n_tokens for r in rows} == dict(want)
    assert {r.tokenizer for r in rows} == {"byte_bpe_50k/1"} and sum(r.n_docs for r in rows) == 200
