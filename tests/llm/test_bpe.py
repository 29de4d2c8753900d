"""Byte-pair encoding against the tiktoken library, and exact round trips."""

import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tiffin.llm import bpe
from tiffin.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


HARD = st.one_of(
    st.text(max_size=200),
    st.text("ab ", max_size=300),
    st.text("aA1 '\n.été漢", max_size=300),
    st.lists(st.sampled_from(["the", "ing", "tion", "aaaa", "=", " ", "\n\n", "00", "é", "'ll", "ab"]), max_size=120).map("".join),
)


@settings(max_examples=600, deadline=None)
@given(HARD)
def test_equals_the_library(library, encoder, text):
    packed = encoder.encode(text)
    assert ids(packed) == library.encode_ordinary(text)
    assert encoder.decode(packed) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=2, max_size=6), st.integers()), max_size=40), st.text("abc", min_size=1, max_size=80), st.integers(1, 9))
def test_any_ranks(made, text, leaf):
    """Whatever the ranks and leaves, the tree gives what merging all bytes at once gives."""
    extra = sorted({bytes(b"abc"[c % 3] for c in data): n for data, n in made}.items(), key=lambda item: item[1])
    ranks = {bytes([n]): n for n in range(256)} | {data: 256 + n for n, (data, _) in enumerate(extra)}
    own, before = bpe.Encoder(ranks, ".+"), bpe.LEAF
    bpe.LEAF = leaf
    try:
        assert own.reduce(text.encode()) == naive(text.encode(), ranks)
    finally:
        bpe.LEAF = before


def naive(data, ranks):
    parts = [data[n : n + 1] for n in range(len(data))]
    while True:
        pairs = [(ranks[a + b], n) for n, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        _, n = min(pairs)
        parts[n : n + 2] = [parts[n] + parts[n + 1]]


def test_every_code_point(library, encoder):
    text = "".join(f"x{c}x {c} 1{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for n in range(0, len(text), 100_000):
        assert ids(encoder.encode(text[n : n + 100_000])) == library.encode_ordinary(text[n : n + 100_000])


def test_long_pieces(library, encoder, rng):
    for text in ("a" * 30_001, "=" * 9_999, "ab" * 9_000, "".join(rng.choices("abcde", k=20_000)), " " * 5_000 + "x"):
        assert ids(encoder.encode(text)) == library.encode_ordinary(text)


def digests(text, library):
    numbers = library.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(numbers)}I", *numbers)
    return len(numbers), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows(documents, library, rng, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 10)
    rows = [
        (1, None), (2, ""), (None, "no id"), (9007199254740993, "x"), (3, "same"), (3, "same"), (4, "<|endoftext|> \x00 \x1c"),
        (5, prose(rng, 60_000, 9_000)), (6, "퟿\U0010ffff"),
    ]
    out = bpe.encode_documents(documents(*rows, extra="ids n_tokens piece"), PATH, public_tokenizers.PATTERN, True)
    kept = out.collect()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept), key=str)
    assert got == sorted(((i, *digests(t, library)) for i, t in rows), key=str)
    back = bpe.decode_documents(out, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_no_rows(documents):
    assert bpe.encode_documents(documents().limit(0), PATH, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_on_all_documents(spark, library, folder):
    out = LLM_QUERIES["op12_byte_bpe"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *digests(r.text, library)) for r in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
