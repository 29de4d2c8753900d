"""Each stage on what the one before kept, against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_decontam import expected as contaminated
from tests.llm.test_jaccard import expected as grouped
from tests.llm.test_mixing import by_rounds
from tiffin.llm.common import new_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage made of them."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder, out = new_folder(spark, "stages"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_drops_only_what_has_none(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert {i for i in before if any(c.isalpha() for c in before[i])} == set(after)


def test_one_of_each_group_stays(stages):
    rows = list(texts(stages[1]).items())
    want = {component for _, component in grouped(rows, 5, 80).values()}
    assert set(texts(stages[2])) == want


def test_no_benchmark_item_stays(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    before = texts(stages[2])
    leaked = {i for i, _ in contaminated(before.items(), items)}
    assert set(texts(stages[3])) == set(before) - leaked and leaked


def test_mix_repeats_rows(stages):
    times = Counter(r.doc_id for r in stages[4].collect())
    assert set(times) <= set(texts(stages[3])) and set(times.values()) <= {1, 2}


def test_mix_follows_the_targets(stages):
    before, after, longest = Counter(), Counter(), Counter()
    for row in stages[3].collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))
        before[row.source] += n
        longest[row.source] = max(n, longest[row.source])
    for row in stages[4].collect():
        after[row.source] += len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))
    targets = by_rounds(before)
    # Repetitions are whole: what is counted in part is at most the last document of a source.
    assert all(abs(after[s] - targets[s]) <= longest[s] for s in before)


def test_all_rows_are_sharded(spark, stages):
    out = stages[5].collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in stages[4].collect())
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.size, r.shard) for r in again) == Counter((r.doc_id, r.size, r.shard) for r in out)
