"""Exact dedup against grouping the texts themselves."""

import hashlib

import pytest

from tests.compare import connect, differences
from tiffin.llm.exact import exact_dedup
from tiffin.llm.queries import LLM_ORACLES, LLM_QUERIES


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str)


ROWS = [
    (1, "abcdefgh"), (2, "abcdefgh"), (3, "abcdefgi"), (4, ""), (5, None), (None, "abcdefgh"), (7, "é" * 9), (8, "é" * 9),
    (9, "x" * 5000), (10, "x" * 5000), (11, "x" * 4999 + "y"), (12, "abcd"), (12, "abcd"), (13, "efgh"), (14, "abcdabcd"),
]


@pytest.mark.parametrize("block_bytes, key_bits", [(4096, 64), (4, 64), (4, 3), (3, 1)])
def test_equal_texts_share_an_identity(documents, block_bytes, key_bits):
    """Also where nearly all block keys collide."""
    out = exact_dedup(documents(*ROWS, extra="_key kept _bytes"), block_bytes, key_bits).collect()
    found = sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=str)
    assert found == expected(ROWS)
    for digest in {r.text_sha256 for r in out}:
        assert sum(r.kept for r in out if r.text_sha256 == digest) == 1
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_no_rows(documents):
    assert exact_dedup(documents().limit(0)).count() == 0


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = LLM_QUERIES["op3_exact_dedup"](spark, folder)
    assert differences(found, connect(folder), LLM_ORACLES["op3_exact_dedup"]) == []
