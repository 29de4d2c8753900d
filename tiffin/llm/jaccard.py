"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles. All shingles have one global order: rare ones first, by the number of
documents that have them. Documents x and y with Jaccard similarity of at least t have an overlap of at least
``alpha(x, y)``, so they share one of the first ``|x| - t|x| + 1`` shingles of each, and ``k`` of the first
``|x| - t|x| + k``. Every document estimates the candidates that its shortest prefix would bring (the sum of
its shingles' frequencies); the more there are, the longer its prefix and the more shared shingles are
asked for before a pair is verified.

The frequencies of all shingles are counted exactly. Texts are read in chunks; a chunk sends its shingles
to hash ranges in packed form, where they are counted, and gets back, per document, how many are
in no other document, and the others with their frequencies. A shingle that several documents of a chunk have
is sent once with its count, so one that a third of all documents have costs a row per chunk. A shingle in
no other document can't be part of an overlap: most documents have too many of those to have a partner.

Of the rest, equal sets are put together, and one set of each kind stands for its copies. Links are looked for in two
rounds. In the first, each prefix shingle links its documents to the most central of them. In the second, pairs are
formed only between documents that the first round left in different components, so a large group of near copies
doesn't become all its pairs, while every link that could join two components is tried.

That gives the components (``similar_groups``). A link never leaves one, so all links (``linked_groups``,
``class_links``) are found by comparing the kinds of each component in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.cells import Overlaps, in_cells
from tiffin.llm.common import pinned, small_batches, without_ids
from tiffin.llm.components import components
from tiffin.llm.shingles import mix, plain_words, shingled, slices

#: Bytes of text for each hash range in which shingles are counted together.
RANGE_BYTES = 16_000_000
#: Longs of a set's parity sketch: each shingle flips one bit, so two sketches differ in no more bits than
#: the sets in shingles.
PARITY_LONGS = 8
#: Candidates of the shortest prefix from which on a prefix is lengthened; four shingles for each doubling.
CHEAP = 16

_ASSEMBLED = (
    "node long, doc_id long, size long, set_a long, set_b long, alone long, wanted int, shortest int, "
    "prefix array<long>, shared binary, " + ", ".join(f"parity{n} long" for n in range(PARITY_LONGS))
)
#: What equal sets have in common.
KIND = ["size", "set_a", "set_b"]
_U32, _U64 = np.dtype("<u4"), np.dtype("<u8")


class Packer:
    """Arrays written one after the other, each with its length."""

    def __init__(self):
        self.parts: list[bytes] = []

    def add(self, array: np.ndarray) -> None:
        data = np.ascontiguousarray(array).tobytes()
        self.parts += [len(data).to_bytes(8, "little"), data]

    def done(self) -> bytes:
        return b"".join(self.parts)


class Unpacker:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self, kind) -> np.ndarray:
        size = int.from_bytes(self.data[self.at : self.at + 8], "little")
        begin = self.at + 8
        self.at = begin + size
        return np.frombuffer(self.data, kind, size // np.dtype(kind).itemsize, begin)


def _add_names(out: Packer, names: np.ndarray) -> None:
    """The low 40 bits of shingles: with the range they are in, a shingle's name."""
    out.add((names & np.uint64(0xFFFFFFFF)).astype(_U32))
    out.add(((names >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8))


def _get_names(data: Unpacker) -> np.ndarray:
    low = data.get(_U32).astype(np.uint64)
    return low | (data.get(np.uint8).astype(np.uint64) << np.uint64(32))


def _range_of(shingles: np.ndarray, ranges: int) -> np.ndarray:
    return (((shingles >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _full(range_: np.ndarray | int, names: np.ndarray) -> np.ndarray:
    return mix(names + (np.asarray(range_).astype(np.uint64) << np.uint64(40)))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values, wrapping."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _chunk(first: int, ids: list, texts: list[str], size: int, ranges: int, chunk: int):
    """Rows (range, chunk, data) of one chunk: its shingles by range, and under a negative range what it keeps."""
    words, word_at = plain_words(texts)
    shingles, at = shingled(words, word_at, size)
    docs = len(texts)
    doc = np.repeat(np.arange(docs), np.diff(at))
    order = np.lexsort((shingles, doc))
    shingles = shingles[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    shingles, doc = shingles[new], doc[new]
    counts = np.bincount(doc, minlength=docs)
    keep = Packer()
    keep.add(np.array([first], np.int64))
    keep.add(np.array([i is None for i in ids], bool))
    keep.add(np.array([i or 0 for i in ids], np.int64))
    keep.add(counts.astype(_U32))
    keep.add(_sums(mix(shingles), counts))
    keep.add(_sums(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), counts))
    bits = (mix(shingles + np.uint64(1)) % np.uint64(64 * PARITY_LONGS)).astype(np.int64)
    flips = np.bincount(doc * 64 * PARITY_LONGS + bits, minlength=docs * 64 * PARITY_LONGS).astype(np.uint8) & 1
    keep.add(np.packbits(flips.reshape(docs, -1), axis=1, bitorder="little"))

    distinct, place, many = np.unique(shingles, return_inverse=True, return_counts=True)
    repeated = many > 1
    # Shingles of several documents: kept as (document, index), sent once.
    index = np.cumsum(repeated) - 1
    some = repeated[place]
    keep.add(np.bincount(doc[some], minlength=docs).astype(_U32))
    keep.add(index[place[some]].astype(_U32))
    common, common_many = distinct[repeated], many[repeated]
    common_range = _range_of(common, ranges)
    keep.add(_full(common_range, common & np.uint64(0xFFFFFFFFFF)))
    # Shingles of one document, by range and then document.
    single, single_doc = shingles[~some], doc[~some]
    range_of = _range_of(single, ranges)
    order = np.argsort(range_of, kind="stable")
    single, single_doc, range_of = single[order], single_doc[order], range_of[order]
    yield -1 - chunk, chunk, keep.done()
    here = np.arange(ranges + 1)
    bounds, common_bounds = np.searchsorted(range_of, here), np.searchsorted(common_range, here)
    for r in np.union1d(range_of, common_range):
        a, b = bounds[r], bounds[r + 1]
        c, d = common_bounds[r], common_bounds[r + 1]
        out = Packer()
        out.add(np.bincount(single_doc[a:b], minlength=docs).astype(_U32))
        _add_names(out, single[a:b])
        _add_names(out, common[c:d])
        out.add(common_many[c:d].astype(_U32))
        yield int(r), chunk, out.done()


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """Count the shingles of one range; answer each chunk."""
    if rows["range"].iloc[0] < 0:
        return rows
    read = []
    for data in rows["data"]:
        packed = Unpacker(data)
        read.append((packed.get(_U32), _get_names(packed), _get_names(packed), packed.get(_U32)))
    names = np.concatenate([a for _, single, common, _ in read for a in (single, common)])
    weight = np.concatenate(
        [a for _, single, _, many in read for a in (np.ones(len(single), np.int64), many.astype(np.int64))]
    )
    _, place = np.unique(names, return_inverse=True)
    seen = np.bincount(place, weight).astype(np.int64)[place]
    out, at = [], 0
    for per_doc, single, common, _ in read:
        own = seen[at : at + len(single)]
        at += len(single)
        of_common = seen[at : at + len(common)]
        at += len(common)
        shared = own > 1
        kept = _sums(shared.astype(np.int64), per_doc.astype(np.int64))
        answer = Packer()
        answer.add((per_doc - kept).astype(_U32))
        answer.add(kept.astype(_U32))
        _add_names(answer, single[shared])
        answer.add(own[shared].astype(_U32))
        answer.add(of_common.astype(_U32))
        out.append(answer.done())
    return rows.assign(data=out)


def _assemble(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Sets, prefixes and sketches of the documents of one chunk that may have a partner; sizes of all."""
    rows = rows.sort_values("range")
    kept = Unpacker(rows["data"].iloc[0])
    begin, null, ids = kept.get(np.int64)[0], kept.get(np.bool_), kept.get(np.int64)
    sizes = kept.get(_U32).astype(np.int64)
    set_a, set_b = kept.get(_U64), kept.get(_U64)
    parity = kept.get(_U64).reshape(len(ids), PARITY_LONGS).astype(np.int64)
    common_per_doc, common_at, common_names = kept.get(_U32).astype(np.int64), kept.get(_U32), kept.get(_U64)
    everyone = np.arange(len(ids))
    alone = np.zeros(len(ids), np.int64)
    docs, names, seen, of_common = [], [], [], [np.empty(0, np.int64)]
    for r, data in zip(rows["range"].iloc[1:], rows["data"].iloc[1:]):
        answer = Unpacker(data)
        alone += answer.get(_U32)
        docs.append(np.repeat(everyone, answer.get(_U32)))
        names.append(_full(r, _get_names(answer)))
        seen.append(answer.get(_U32))
        of_common.append(answer.get(_U32).astype(np.int64))
    docs.append(np.repeat(everyone, common_per_doc))
    names.append(common_names[common_at])
    seen.append(np.concatenate(of_common)[common_at])
    docs, names, seen = np.concatenate(docs), np.concatenate(names), np.concatenate(seen)
    order = np.lexsort((names, seen, docs))
    docs, names, seen = docs[order], names[order].astype(np.int64), seen[order]
    bounds = np.searchsorted(docs, np.arange(len(ids) + 1))
    out = []
    for d in everyone:
        size, u = int(sizes[d]), int(alone[d])
        least = -(-size * percent // 100)
        row = [int(begin + d), None if null[d] else int(ids[d]), size]
        row += [int(set_a[d].astype(np.int64)), int(set_b[d].astype(np.int64)), u]
        if not size or size - u < least:
            out.append(row + [None] * (4 + PARITY_LONGS))
            continue
        own, own_seen = names[bounds[d] : bounds[d + 1]], seen[bounds[d] : bounds[d + 1]]
        shortest = size - least + 1 - u
        cost = int((own_seen[:shortest] - 1).sum())
        wanted = min(1 + 4 * int(np.log2(max(1, cost / CHEAP))), least)
        prefix = own[: shortest + wanted - 1]
        row += [wanted, shortest, prefix.tolist(), np.sort(own).tobytes()]
        out.append(row + parity[d].tolist())
    # As objects: a column with nulls would else become floats, which don't hold 64 bits.
    return pd.DataFrame(out, columns=[c.split()[0] for c in _ASSEMBLED.split(", ")], dtype=object)


def prepared(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that have a text as sets, in the columns of ``_ASSEMBLED``.

    ``node`` numbers the rows, with gaps; ``prefix`` is null where no partner is possible. The result is to be
    pinned: rows may be numbered otherwise the next time.
    """
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").filter("text IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-total // RANGE_BYTES))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            # Ids come as text, since numbers with nulls among them would come as floats.
            ids, texts = [None if i is None else int(i) for i in batch["doc_id"]], batch["text"].tolist()
            for begin, end in slices(texts):
                place = (part << 40) + row
                rows = list(_chunk(place, ids[begin:end], texts[begin:end], size, ranges, (part << 32) + chunk))
                chunk, row = chunk + 1, row + end - begin
                yield pd.DataFrame(rows, columns=["range", "chunk", "data"])

    packed = "range long, chunk long, data binary"
    answered = texts.mapInPandas(send, packed).groupBy("range").applyInPandas(_count, packed)

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        return _assemble(rows, percent)

    return answered.groupBy("chunk").applyInPandas(assemble, _ASSEMBLED)


def _alpha(percent: int):
    """The least overlap of two sets at the similarity, from their sizes: 100 * o >= percent * (x + y - o)."""
    both = (F.col("x.size") + F.col("y.size")) * percent
    return F.ceil(both / (100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough prefix shingles and then reach the similarity."""

    @F.pandas_udf("boolean")
    def similar(
        x: pd.Series, y: pd.Series, px: pd.Series, py: pd.Series, wx: pd.Series, wy: pd.Series, nx: pd.Series, ny: pd.Series
    ) -> pd.Series:
        out = np.zeros(len(x), bool)
        for n, (a, b, pa, pb, wa, wb, na, nb) in enumerate(zip(x, y, px, py, wx, wy, nx, ny)):
            if len(np.intersect1d(pa, pb)) < min(wa, wb):
                continue
            same = len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
            out[n] = 100 * same >= percent * (na + nb - same)
        return pd.Series(out)

    own = sets.select("node", "size", "wanted", "prefix", "shared")
    x = own.select(*[F.col(c).alias(f"x_{c}") for c in own.columns])
    y = own.select(*[F.col(c).alias(f"y_{c}") for c in own.columns])
    filled = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    names = ["shared", "prefix", "wanted", "size"]
    alike = similar(*[F.col(f"{side}_{name}") for name in names for side in "xy"])
    return pinned(filled.filter(alike).select("a", "b"))


def links(sets: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b), a < b, enough for the components.

    ``heads`` lists one node per different set of ``sets``.
    """
    parity = [f"parity{n}" for n in range(PARITY_LONGS)]
    postings = pinned(
        sets.join(heads, "node", "left_semi")
        .select(
            "node", "size", "alone", *parity, F.posexplode(F.slice("prefix", 1, F.col("shortest"))).alias("_at", "shingle")
        )
        .select("shingle", "node", "size", (F.col("_at") + F.col("alone")).alias("place"), *parity)
    )
    busy = postings.groupBy("shingle").agg(F.count("*").alias("_n")).filter("_n > 1").select("shingle")
    postings = pinned(postings.join(busy, "shingle", "left_semi"))
    alpha = _alpha(percent)
    apart = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in parity), F.lit(0))
    # If this shingle is the first that both have, no more than what comes from it on can be shared.
    possible = (
        (F.col("x.size") - F.col("x.place") >= alpha)
        & (F.col("y.size") - F.col("y.place") >= alpha)
        & (F.least("x.size", "y.size") >= alpha)
        & (apart <= F.col("x.size") + F.col("y.size") - 2 * alpha)
    )
    same = F.col("x.shingle") == F.col("y.shingle")
    centre = pinned(postings.groupBy("shingle").agg(F.min(F.struct("place", "node", "size", *parity)).alias("_c")))
    centre = centre.select("shingle", "_c.*")
    first = (
        postings.alias("x")
        .join(centre.alias("y"), same & (F.col("x.node") != F.col("y.node")) & possible)
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )
    found = _verified(pinned(first), sets, percent)
    label = components(found).select(F.col("id").alias("_id"), "component")
    labelled = pinned(
        postings.join(label, F.col("node") == F.col("_id"), "left")
        .withColumn("label", F.coalesce("component", "node"))
        .drop("_id", "component")
    )
    second = (
        labelled.alias("x")
        .join(
            labelled.alias("y"),
            same & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & possible,
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )
    more = _verified(pinned(second), sets, percent)
    return found.unionByName(more)


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows as prepared; a head and the number of rows of each different set; the components of the heads."""
    small_batches(docs.sparkSession)
    ready = pinned(prepared(docs, size, percent))
    heads = ready.filter("size > 0").groupBy(*KIND)
    heads = pinned(heads.agg(F.min("node").alias("_head"), F.count("*").alias("_many"), F.min("doc_id").alias("_least")))
    sets = ready.filter("prefix IS NOT NULL")
    return ready, heads, components(links(sets, heads.select(F.col("_head").alias("node")), percent))


def _linked_in(rows: pd.DataFrame, percent: int):
    """Nodes of the two tiles of a cell, how many rows each has, and whether they link."""
    parts = [np.frombuffer(data, np.int64) for data in rows["shared"]]
    # Shingles that a set has alone count for its size only.
    overlaps = Overlaps(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    overlaps.sizes = rows["size"].to_numpy(np.int64)
    tile, low, high = rows["_tile"].to_numpy(), rows["_low"].iloc[0], rows["_high"].iloc[0]
    left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    alike = overlaps.alike(left, right, percent)
    if low == high:
        np.fill_diagonal(alike, False)
    nodes, many = rows["node"].to_numpy(np.int64), rows["_many"].to_numpy(np.int64)
    return nodes[left], nodes[right], many[left], many[right], alike


def _cells(ready: DataFrame, heads: DataFrame, parts: DataFrame):
    """The different sets of each component, grouped by cell."""
    own = heads.select(F.col("_head").alias("node"), "_many").join(parts, F.col("node") == F.col("id")).drop("id")
    sets = ready.filter("prefix IS NOT NULL").select("node", "size", "shared")
    return in_cells(pinned(sets.join(own, "node")), "component", "node", "shared").groupBy("component", "_low", "_high")


def _link_counts(ready: DataFrame, heads: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(_linked, _more): to how many rows of other sets each head has a link."""

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, many_left, many_right, alike = _linked_in(rows, percent)
        sums = [(left, alike @ many_right)]
        if rows["_low"].iloc[0] != rows["_high"].iloc[0]:
            sums.append((right, many_left @ alike))
        return pd.DataFrame({"_linked": np.concatenate([s[0] for s in sums]), "_more": np.concatenate([s[1] for s in sums])})

    some = _cells(ready, heads, parts).applyInPandas(counted, "_linked long, _more long")
    return some.groupBy("_linked").agg(F.sum("_more").alias("_more"))


def _grouped(docs: DataFrame, ready: DataFrame, heads: DataFrame, parts: DataFrame, counted: DataFrame | None) -> DataFrame:
    """doc_id, n_shingles, component_id and, from ``counted``, n_links of every row of ``docs``."""
    # A component takes the smallest doc_id of all rows of all its sets; a link counts all rows of the other set.
    named = heads.join(parts, F.col("_head") == F.col("id"), "left")
    more = []
    if counted is not None:
        named = named.join(counted, F.col("_head") == F.col("_linked"), "left")
        named = named.withColumn("n_links", F.col("_many") - 1 + F.coalesce("_more", F.lit(0)))
        more = ["n_links"]
    named = pinned(named.select(*KIND, "_least", *more, F.coalesce("component", "_head").alias("_part")))
    least = named.groupBy(F.col("_part").alias("_of")).agg(F.min("_least").alias("component_id"))
    named = pinned(named.join(least, F.col("_part") == F.col("_of")).select(*KIND, "component_id", *more))
    rows = ready.filter("size > 0").select("doc_id", *KIND)
    linked = rows.join(named, KIND).select("doc_id", F.col("size").alias("n_shingles"), "component_id", *more)
    bare = ready.filter("size = 0").select("doc_id").unionByName(docs.filter("text IS NULL").select("doc_id"))
    none = F.lit(0).cast("long")
    bare = bare.select(
        "doc_id", none.alias("n_shingles"), F.col("doc_id").alias("component_id"), *[none.alias(name) for name in more]
    )
    return linked.unionByName(bare)


def similar_groups(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Words are cut at ASCII white space, A-Z lower-cased; a text of fewer words than ``size`` has its whole
    sequence as one shingle. Texts link if 100 * overlap >= percent * union; ``component_id`` is the
    smallest doc_id reachable by links, the row itself included. Null, empty and blank texts have no
    shingles and no links. Rows without doc_id take part; a component of such rows only has a null id. Equal
    rows give equal rows. Only doc_id and text are read. Different shingles share a name with a chance of
    one in 2^40 times the number of ranges; sets are told apart by 128 bits of hash.
    """
    return _grouped(docs, *_classes(docs, size, percent), None)


def linked_groups(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``similar_groups`` and n_links: to how many other rows a row has a link, equal ones included.

    All pairs of different sets of a component are compared; copies are counted by the rows of a set.
    """
    classes = _classes(docs, size, percent)
    return _grouped(docs, *classes, _link_counts(*classes, percent))


def class_links(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(left_id, right_id) of every link between different sets, each by the smallest doc_id of its rows."""
    ready, heads, parts = _classes(docs, size, percent)

    def paired(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, _, _, alike = _linked_in(rows, percent)
        x, y = np.nonzero(alike)
        a, b = left[x], right[y]
        once = (a < b) | (rows["_low"].iloc[0] != rows["_high"].iloc[0])
        return pd.DataFrame({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once]})

    found = pinned(_cells(ready, heads, parts).applyInPandas(paired, "a long, b long"))
    left = heads.select(F.col("_head").alias("a"), F.col("_least").alias("left_id"))
    right = heads.select(F.col("_head").alias("b"), F.col("_least").alias("right_id"))
    return found.join(left, "a").join(right, "b").select("left_id", "right_id")


def one_per_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; all columns are kept.

    Rows without doc_id stay, and rows that share a doc_id stay or go together.
    """
    groups = similar_groups(docs, size, percent)
    return without_ids(docs, groups.filter("doc_id > component_id").select("doc_id"))
