"""Byte-level BPE: encoding as a reduction over a tree of byte strings, and decoding.

The tokens of a byte string are those of its two halves, joined. Two facts make the join exact, whatever the ranks.
A run of neighbours out of a list of tokens is what its own bytes encode to, since merges inside it came in the order in
which it would have made them alone. And a list of tokens is the encoding of its bytes if every two neighbours are the
encoding of theirs: the first merge across a border between two tokens would also have been made by these two alone.

So if the tokens at a border are stable as a pair, the lists are concatenated. Otherwise a window of tokens around the
border is encoded anew and grows, twice as many tokens each time, at the side where its edge isn't stable with the
token outside it, until both edges are: then no token outside can change.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import small_batches
from tiffin.llm.shingles import slices

#: Bytes that are merged one by one; longer strings are halved.
LEAF = 24
#: Different pieces whose tokens a task remembers, and the longest of them.
KNOWN_PIECES = 400_000
KNOWN_BYTES = 64
#: Token ids that decoding joins at once at the leaves of its tree.
DECODE_LEAF = 4_096


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids, out of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of ``data`` by merging, again and again, the pair of neighbours with the least rank, the left of equals."""
    ends = list(range(1, len(data) + 1))  # by where a part begins: where it ends
    begins = list(range(-1, len(data)))  # by where a part begins: where the one before it does
    begins.append(len(data) - 1)
    queue = [(rank, n, n + 2) for n in range(len(data) - 1) if (rank := ranks.get(data[n : n + 2])) is not None]
    heapq.heapify(queue)
    alive = [True] * len(data)
    while queue:
        _, begin, stop = heapq.heappop(queue)
        if not alive[begin] or ends[begin] == len(data):
            continue
        other = ends[begin]
        if ends[other] != stop:
            continue  # one of the two has changed since
        alive[other] = False
        ends[begin] = stop
        if stop < len(data):
            begins[stop] = begin
            rank = ranks.get(data[begin : ends[stop]])
            if rank is not None:
                heapq.heappush(queue, (rank, begin, ends[stop]))
        before = begins[begin]
        if before >= 0:
            rank = ranks.get(data[before:stop])
            if rank is not None:
                heapq.heappush(queue, (rank, before, stop))
    return [data[n : ends[n]] for n in range(len(data)) if alive[n]]


class Encoder:
    """Encodes and decodes with one set of ranks; every single byte has to have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        if any(bytes([n]) not in ranks for n in range(256)):
            raise ValueError("a byte without a rank")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {n: data for data, n in ranks.items()}
        self.stable = lru_cache(1 << 18)(self._stable)
        self.known: dict[str, bytes] = {}

    def _stable(self, left: bytes, right: bytes) -> bool:
        return merged(left + right, self.ranks) == [left, right]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The tokens of two neighbouring strings, out of the tokens of each."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a, b = 1, 1  # tokens of each side in the window
        while True:
            window = merged(b"".join(left[-a:] + right[:b]), self.ranks)
            loose = a < len(left) and not self.stable(left[-a - 1], window[0])
            slack = b < len(right) and not self.stable(window[-1], right[b])
            if not loose and not slack:
                return left[:-a] + window + right[b:]
            a = min(len(left), 2 * a) if loose else a
            b = min(len(right), 2 * b) if slack else b

    def reduce(self, data: bytes) -> list[bytes]:
        """The tokens of ``data``: those of its halves, joined."""
        if len(data) <= LEAF:
            return merged(data, self.ranks)
        middle = len(data) // 2
        return self.join(self.reduce(data[:middle]), self.reduce(data[middle:]))

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern, as little-endian 32-bit integers. A match that is a token has that id."""
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.reduce(data)]
        packed = np.array(ids, "<u4").tobytes()
        if len(data) <= KNOWN_BYTES:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of the tokens of ``text``, as little-endian 32-bit integers."""
        known, piece = self.known.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ``ids`` stand for: leaves, then neighbours joined up the tree."""
        numbers, token = np.frombuffer(ids, "<u4"), self.token.__getitem__
        parts = [
            b"".join(map(token, numbers[n : n + DECODE_LEAF].tolist())) for n in range(0, len(numbers), DECODE_LEAF)
        ]
        while len(parts) > 1:
            parts = [b"".join(parts[n : n + 2]) for n in range(0, len(parts), 2)]
        return parts[0] if parts else b""


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ``ids`` (binary) of every row of ``docs``.

    ``path`` is a file of ranks on the driver (it is sent to the tasks: as many entries as the vocabulary has),
    ``pattern`` what cuts a text into pieces. Ids are little-endian unsigned 32-bit integers. Null texts
    count as empty: no tokens. Equal rows give equal rows; an empty table gives none. Only doc_id and text are read.
    No row depends on another, so a text is the largest thing that a task holds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((read_ranks(path), pattern))
    schema = ENCODED + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(*sent.value)
        for batch in batches:
            doc_ids = [None if i is None else int(i) for i in batch["doc_id"]]
            texts = [t or "" for t in batch["text"]]
            for begin, end in slices(texts):
                out = []
                for doc_id, text in zip(doc_ids[begin:end], texts[begin:end]):
                    ids = encoder.encode(text)
                    digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()
                    out.append((doc_id, len(ids) // 4, *digests, ids)[: len(names)])
                rows = pd.DataFrame(out, columns=names)
                rows["doc_id"] = pd.array([row[0] for row in out], "Int64")
                yield rows

    # Ids as text: a batch with null ids would come as floats.
    return docs.select(F.col("doc_id").cast("long").cast("string"), "text").mapInPandas(encode, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of every row of ``encoded`` (doc_id, ids); null ids give a null text.

    Ids that are no text in UTF-8 fail, and so do ids that are not in the file of ranks.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(sent.value, "")
        for ids in batches:
            yield pd.Series([None if i is None else encoder.decode(i).decode() for i in ids], dtype=object)

    return encoded.select("doc_id", decode("ids").alias("text"))
