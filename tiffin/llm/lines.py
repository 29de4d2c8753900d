"""Fuzzy line dedup by MinHash: signatures of character shingles, banding, exact Jaccard, union-find.

A line's signature holds, for each of BANDS * ROWS bins, the smallest hash among the shingles that fall into the
bin (empty bins borrow from the next filled one). Lines that agree in all rows of a band are candidates: at
similarity 0.8, 99.5 % of pairs share a band. Candidates that reach the threshold by the exact similarity of their
shingle sets are links; one line per component of links stays.

Chunks of text send their band names to ranges in packed form, which find the bands that several lines share. All
lines of those bands are compared: in CENTRES rounds each with one line of its band, then all pairs of a band that
are still in different components. Set sizes and parity sketches rule out most pairs that are
no links before their texts are read; they never rule out a link. A band that would still have more than PAIRS pairs a
line is compared in cells of bounded size, which give back no more links than lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.cells import Overlaps, in_cells
from tiffin.llm.common import maybe_in, pinned, small_batches
from tiffin.llm.components import components
from tiffin.llm.jaccard import Packer, Unpacker
from tiffin.llm.shingles import mix, slices

SHINGLE_CHARS = 8
THRESHOLD_PERCENT = 80
BANDS = 10
ROWS = 4
#: Longs of a line's parity sketch: two sketches differ in no more bits than the shingle sets in shingles.
PARITY_LONGS = 8
PARITY = [f"parity{n}" for n in range(PARITY_LONGS)]
#: Rounds that compare the lines of a band with one of them, before all pairs that are left.
CENTRES = 1
#: Pairs a line up to which those of a band are made as rows.
PAIRS = 16
#: Lines of a cell that are compared with all its lines at once.
STEP = 64
#: Bytes of text for each range of band names that is paired together.
RANGE_BYTES = 32_000_000
_U64 = np.dtype("<u8")
_K = np.uint64(0x9E3779B97F4A7C15)


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial in _K of each run of ``size`` codes, from those of half the length."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    out, width, power = codes, 1, _K
    with np.errstate(over="ignore"):
        for bit in f"{size:b}"[1:]:
            out = out[:-width] * power + out[width:]
            width, power = 2 * width, power * power
            if bit == "1":
                out = out[:-1] * _K + codes[width:]
                width, power = width + 1, power * _K
    return out


def char_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` characters of each text (of all, if it has fewer), and the text of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = mix(codes + _K)
    rolled = _rolled(codes, size)
    begin = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - size + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(begin - first, counts) + np.arange(counts.sum())
    owner = np.repeat(np.arange(len(texts)), counts)
    short = np.flatnonzero((lengths > 0) & (counts == 0))
    values = []
    for n in short:
        value = np.full(1, lengths[n], np.uint64)
        for code in range(begin[n], begin[n] + lengths[n]):
            value = value * _K + codes[code : code + 1]
        values.append(value)
    hashes = np.concatenate([rolled[at], *values]) if len(short) else rolled[at]
    return mix(hashes), np.concatenate([owner, short])


def band_names(texts: list[str], size: int = SHINGLE_CHARS, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Names of the bands of each text, one row each; no text is empty."""
    bins = bands * rows
    hashes, owner = char_shingles(texts, size)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(texts) * bins, none, np.uint64)
    np.minimum.at(least, owner * bins + (hashes % np.uint64(bins)).astype(np.int64), hashes >> np.uint64(8))
    least = least.reshape(len(texts), bins)
    places = np.arange(2 * bins)
    following = np.where(np.tile(least != none, 2), places, 2 * bins)
    following = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1][:, :bins]
    distance = (following - places[:bins]).astype(np.uint64)
    signature = np.take_along_axis(least, following % bins, axis=1) + distance * _K
    out = np.zeros((len(texts), bands), np.uint64)
    for part in np.moveaxis(signature.reshape(len(texts), bands, rows), 2, 0):
        out = mix(out * _K + part)
    return mix(out + np.arange(bands, dtype=np.uint64) * _K)


def line_names(lines: list[str]) -> np.ndarray:
    """The same 64-bit hash of each line as ``F.xxhash64`` has."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(line.encode(), 42) for line in lines), np.uint64, len(lines))


def char_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text in order, one text after the other, and where each text's begin."""
    hashes, owner = char_shingles(texts, size)
    if len(owner) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
        hashes[begin:end].sort()
    new = np.ones(len(owner), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def sketches(lines: list[str], size: int) -> pd.DataFrame:
    """Number of different shingles of each line, and its parity sketch: each shingle flips one bit."""
    hashes, at = char_sets(lines, size)
    owner = np.repeat(np.arange(len(lines)), np.diff(at))
    wide = 64 * PARITY_LONGS
    bits = (mix(hashes + np.uint64(1)) % np.uint64(wide)).astype(np.int64)
    flips = (np.bincount(owner * wide + bits, minlength=len(lines) * wide) & 1).astype(np.uint8)
    parity = np.packbits(flips.reshape(len(lines), wide), axis=1, bitorder="little").view("<i8")
    return pd.DataFrame({"size": np.diff(at)} | {name: parity[:, n] for n, name in enumerate(PARITY)})


def _different(bands: np.ndarray, lines: np.ndarray):
    """(band, line) rows in order, each once; where a band begins; how many lines it has."""
    order = np.lexsort((lines, bands))
    bands, lines = bands[order], lines[order]
    new = np.ones(len(bands), bool)
    new[1:] = (bands[1:] != bands[:-1]) | (lines[1:] != lines[:-1])
    bands, lines = bands[new], lines[new]
    head = np.ones(len(bands), bool)
    head[1:] = bands[1:] != bands[:-1]
    many = np.diff(np.append(np.flatnonzero(head), len(bands)))
    return bands, lines, head, many


def _chunk(texts: list[str], ranges: int):
    """Rows (range, data): the first line of each band by range, and the band's other lines under a negative one."""
    lines = list({line for text in texts for line in text.split("\n") if line.strip()})
    if not lines:
        return
    names = band_names(lines)
    bands, names, head, many = _different(names.ravel(), np.repeat(line_names(lines), names.shape[1]))
    if not head.all():
        out = Packer()
        out.add(bands[~head])
        out.add(names[~head])
        yield -1 - int(names[~head].sum() % np.uint64(ranges)), out.done()
    bands, names, shared = bands[head], names[head], many > 1
    of = (((bands >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(of, np.arange(ranges + 1))
    for r in np.unique(of):
        own = slice(bounds[r], bounds[r + 1])
        out = Packer()
        out.add(bands[own])
        out.add(names[own])
        out.add(shared[own])
        yield int(r), out.done()


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """(band, line) of the bands that several lines share; a chunk's other lines are in such bands."""
    read = [Unpacker(data) for data in rows["data"]]
    parts = [(packed.get(_U64), packed.get(_U64)) for packed in read]
    bands, lines = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if rows["range"].iloc[0] < 0:
        bands, lines, _, _ = _different(bands, lines)
    else:
        marked = np.unique(bands[np.concatenate([packed.get(np.bool_) for packed in read])])
        bands, lines, head, many = _different(bands, lines)
        kept = np.repeat((many > 1) | np.isin(bands[head], marked, assume_unique=True), many)
        bands, lines = bands[kept], lines[kept]
    return pd.DataFrame({"band": bands.astype(np.int64), "line": lines.astype(np.int64)})


def alike(left: list[str], right: list[str], size: int, percent: int) -> np.ndarray:
    """Whether the shingle sets of each pair have a Jaccard similarity of ``percent`` or more."""
    place = {line: n for n, line in enumerate(dict.fromkeys(left + right))}
    hashes, at = char_sets(list(place), size)
    sets = [hashes[begin:end] for begin, end in zip(at[:-1], at[1:])]
    out = np.zeros(len(left), bool)
    for n, (a, b) in enumerate(zip(left, right)):
        x, y = sets[place[a]], sets[place[b]]
        same = len(np.intersect1d(x, y, assume_unique=True))
        out[n] = 100 * same >= percent * (len(x) + len(y) - same)
    return out


def shared_bands(docs: DataFrame) -> DataFrame:
    """(band, line) names of all lines in the bands that several different lines share."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-total // RANGE_BYTES))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in slices(texts):
                rows = list(_chunk(texts[begin:end], ranges))
                yield pd.DataFrame(rows, columns=["range", "data"])

    sent = docs.select("text").filter("text IS NOT NULL").mapInPandas(send, "range long, data binary")
    return sent.groupBy("range").applyInPandas(_shared, "band long, line long").distinct()


def _cell_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between lines of a cell that join all components its links could join.

    Some lines at a time are compared with all that are in other components. Links make components grow; the lines of
    the largest one need no turn, since the others have theirs.
    """
    ids, label = rows["id"].to_numpy(np.int64), np.unique(rows["label"].to_numpy(np.int64), return_inverse=True)[1]
    tile, across = rows["_tile"].to_numpy(), rows["_low"].iloc[0] != rows["_high"].iloc[0]
    overlaps = Overlaps(*char_sets(rows["line"].tolist(), SHINGLE_CHARS))
    open_, a, b = np.ones(len(ids), bool), [], []
    while True:
        turn = np.flatnonzero(open_ & (label != np.bincount(label).argmax()))[:STEP]
        if not len(turn):
            return pd.DataFrame({"a": a, "b": b}, dtype="int64")
        others = np.flatnonzero(open_)
        link = overlaps.alike(turn, others, percent)
        if across:
            link &= tile[turn][:, None] != tile[others]
        for n, linked in zip(turn.tolist(), link):
            near = others[linked]
            parts, first = np.unique(label[near], return_index=True)
            for part, other in zip(parts.tolist(), near[first].tolist()):
                if part != label[n]:
                    a.append(min(ids[n], ids[other]))
                    b.append(max(ids[n], ids[other]))
                    label[label == part] = label[n]
        open_[turn] = False


def line_groups(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(id, component) of the lines of ``docs`` (text) that have a link to a different line."""
    shared = pinned(shared_bands(docs))
    wanted = pinned(shared.select(F.col("line").alias("id")).distinct())

    @F.pandas_udf("size long, " + ", ".join(f"{name} long" for name in PARITY))
    def sketched(lines: pd.Series) -> pd.DataFrame:
        return sketches(lines.tolist(), SHINGLE_CHARS)

    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("id"), "line")
    lines = lines.filter(maybe_in(wanted)(F.col("id"))).groupBy("id").agg(F.first("line").alias("line"))
    lines = lines.join(wanted, "id", "left_semi").withColumn("_sketch", sketched("line"))
    lines = pinned(lines.select("id", "line", "_sketch.*"))
    rows = pinned(shared.withColumnRenamed("line", "id").join(lines.drop("line"), "id"))

    alpha = F.ceil((F.col("x.size") + F.col("y.size")) * percent / (100 + percent))
    bits = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in PARITY), F.lit(0))
    possible = (F.least("x.size", "y.size") >= alpha) & (bits <= F.col("x.size") + F.col("y.size") - 2 * alpha)
    same = F.col("x.band") == F.col("y.band")

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(alike(left.tolist(), right.tolist(), SHINGLE_CHARS, percent))

    def cell_links(rows: pd.DataFrame) -> pd.DataFrame:
        return _cell_links(rows, percent)

    def verified(pairs: DataFrame) -> DataFrame:
        left = lines.select(F.col("id").alias("a"), F.col("line").alias("_left"))
        right = lines.select(F.col("id").alias("b"), F.col("line").alias("_right"))
        pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        pairs = pinned(pairs).join(left, "a").join(right, "b")
        return pinned(pairs.filter(similar("_left", "_right")).select("a", "b"))

    apart = (F.col("x.label") != F.col("y.label")) & same & possible
    found, labelled = None, rows.withColumn("label", F.col("id"))
    for turn in range(CENTRES):
        # Centres are written first, and read back so that a band of many lines can be split in the join.
        place = F.xxhash64(F.lit(turn), "id")
        centre = labelled.groupBy("band").agg(F.min(F.struct(place, "id", "label", "size", *PARITY)).alias("_c"))
        more = verified(labelled.alias("x").join(pinned(centre).select("band", "_c.*").alias("y"), apart))
        if found is not None and more.isEmpty():
            continue
        found = more if found is None else found.unionByName(more)
        groups = components(found)
        label = groups.select(F.col("id").alias("_id"), "component")
        labelled = rows.join(label, F.col("id") == F.col("_id"), "left")
        labelled = pinned(labelled.withColumn("label", F.coalesce("component", "id")).drop("_id", "component"))

    parts = labelled.groupBy("band", "label").agg(F.count("*").alias("_n"))
    parts = parts.groupBy("band").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_n")).alias("_same"))
    # Twice the pairs of lines in different components.
    busy = pinned(parts.filter(F.col("_n") * F.col("_n") - F.col("_same") > 2 * PAIRS * F.col("_n")).select("band"))
    crowded = labelled.select("band", "id", "label").join(busy, "band", "left_semi").join(lines.select("id", "line"), "id")
    cells = in_cells(pinned(crowded), "band", "id", "line").groupBy("band", "_low", "_high")
    few = pinned(labelled.join(busy, "band", "left_anti"))
    more = verified(few.alias("x").join(few.alias("y"), apart & (F.col("x.id") < F.col("y.id"))))
    more = more.unionByName(pinned(cells.applyInPandas(cell_links, "a long, b long")))
    return groups if more.isEmpty() else components(found.unionByName(more))


def dedup_lines(docs: DataFrame, percent: int = THRESHOLD_PERCENT, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_kept, kept_lines (numbers from 0) and, if asked for, the kept ``text`` of every row.

    Lines are what line feeds part; blank ones are kept and not compared. Of equal or linked lines the one
    with the smallest doc_id (null last) and line number stays. A null text has no lines and stays null; an
    empty one has one blank line. Lines shorter than a shingle are compared whole. Equal rows are
    documents of their own: the lines of the second are repeats. Different lines share a 64-bit name with a
    chance of 1 in 2^64 a pair. Only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    groups = line_groups(docs, percent).select(F.col("id").alias("_id"), "component")
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    lines = rows.select("_row", "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("_at", "_line"))
    blank = F.col("_line").isNull() | ~F.col("_line").rlike(r"\S")
    kept = ["_line"] if with_text else []
    lines = pinned(
        lines.select(
            "_row", "doc_id", "_at", *kept, F.when(~blank, F.xxhash64("_line")).alias("_name")
        )
    )
    named = lines.join(groups, F.col("_name") == F.col("_id"), "left")
    named = named.withColumn("_part", F.coalesce("component", "_name")).drop("_id", "component")
    first = pinned(
        named.filter("_part IS NOT NULL")
        .groupBy(F.col("_part").alias("_of"))
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "_at")).alias("_first"))
    ).select("_of", F.col("_first._row").alias("_first_row"), F.col("_first._at").alias("_first_at"))
    decided = named.join(first, F.col("_part") == F.col("_of"), "left")
    stays = F.col("_part").isNull() | ((F.col("_row") == F.col("_first_row")) & (F.col("_at") == F.col("_first_at")))
    own = F.when(F.col("_at").isNotNull() & stays, F.struct("_at", *kept))
    out = decided.groupBy("_row", "doc_id").agg(
        F.count("_at").alias("n_lines"), F.array_sort(F.collect_list(own)).alias("_kept")
    )
    shown = [
        F.when(F.col("n_lines") > 0, F.array_join(F.transform("_kept", lambda k: k["_line"]), "\n")).alias("text")
    ]
    return out.select(
        "doc_id",
        "n_lines",
        F.size("_kept").cast("long").alias("n_kept"),
        F.transform("_kept", lambda k: k["_at"]).alias("kept_lines"),
        *(shown if with_text else []),
    )
