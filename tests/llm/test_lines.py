"""Fuzzy line dedup against all pairs of lines."""

import itertools
from collections import Counter

import numpy as np

from tests.llm.conftest import prose
from tests.llm.test_jaccard import Union
from tiffin.llm import cells
from tiffin.llm import lines as lines_module
from tiffin.llm.components import components
from tiffin.llm.lines import _K, _rolled, SHINGLE_CHARS, alike, band_names, dedup_lines, line_groups, line_names


def shingles(line, size=SHINGLE_CHARS):
    return {line[i : i + size] for i in range(len(line) - size + 1)} or {line}


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(rng, line):
    chars = list(line)
    for _ in range(rng.randrange(4)):
        chars[rng.randrange(len(chars))] = rng.choice("äxyz")
    return "".join(chars)


def fixture(rng):
    base = [prose(rng, n, 3000) for n in (4, 10, 20, 20, 40, 40)]
    rows = []
    for n in range(120):
        lines = [edited(rng, rng.choice(base)) for _ in range(2)] + [prose(rng, rng.randrange(1, 15), 3000), ""]
        rng.shuffle(lines)
        rows.append((n, "\n".join(lines)))
    return rows


def test_exact_similarity(rng):
    lines = [edited(rng, b) for b in [prose(rng, 20, 50), "short", "aaaaaaaaaaaaaaaaaaaa"] for _ in range(8)]
    pairs = list(itertools.product(lines, lines))
    found = alike([a for a, _ in pairs], [b for _, b in pairs], SHINGLE_CHARS, 80)
    assert found.tolist() == [similarity(a, b) >= 0.8 for a, b in pairs]


def test_groups_of_similar_lines(documents, rng):
    rows = fixture(rng)
    lines = sorted({line for _, t in rows for line in t.split("\n") if line.strip()})
    union, linked = Union(), 0
    for a, b in itertools.combinations(lines, 2):
        if similarity(a, b) >= 0.8:
            union.join(a, b)
            linked += 1
    assert linked > 300
    want = Counter(union.find(line) for line in lines)
    out = dedup_lines(documents(*rows, extra="n_lines _at"), with_text=True).collect()
    kept = [line for r in out for line in r.text.split("\n") if line.strip()]
    # One line of each component, but for the rare link that no band shows.
    assert len(kept) == len(set(kept)) and {union.find(line) for line in kept} == set(want)
    assert len(kept) - len(want) <= 0.02 * len(lines)
    for r in out:
        text = dict(rows)[r.doc_id].split("\n")
        assert r.n_lines == len(text) and r.text.split("\n") == [text[i] for i in r.kept_lines]


def test_all_links_of_a_crowded_band(documents, rng):
    """Lines of one template, most of them no links, over several chunks: all links that share a band are found."""
    text = "".join(rng.choices("abcdefghij ", k=120))
    lines = []
    for _ in range(150):
        tail = "".join(rng.choices("klmnopqrst", k=22))
        lines += [text + tail, text + tail[:8] + "".join(rng.choices("klmnopqrst", k=14))]
    rng.shuffle(lines)
    names = [int(n) for n in line_names(lines).astype("int64")]
    bands = [set(own) for own in band_names(lines).tolist()]
    union, candidates, linked = Union(), 0, 0
    for a, b in itertools.combinations(range(len(lines)), 2):
        if bands[a] & bands[b]:
            candidates += 1
            if similarity(lines[a], lines[b]) >= 0.8:
                union.join(names[a], names[b])
                linked += 1
    assert linked > 140 and candidates > 20 * linked
    rows = [(n, "\n".join(lines[n::20])) for n in range(20)]
    got = {r.id: r.component for r in line_groups(documents(*rows).repartition(10)).collect()}
    assert got == {n: union.find(n) for n in list(union)}


def test_a_crowded_band_makes_few_pairs(spark, documents, rng, monkeypatch):
    """Lines of one template, apart after the centres: the pairs that become rows don't grow with their square."""
    text, many = "".join(rng.choices("abcdefghij ", k=120)), 300
    lines = []
    for _ in range(many // 2):
        tail = "".join(rng.choices("klmnopqrst", k=22))
        lines += [text + tail, text + tail[:8] + "".join(rng.choices("klmnopqrst", k=14))]
    own, made = lines_module.pinned, []

    def counted(df):
        out = own(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    found = []
    for pairs, rows in ((10**6, 1_024), (16, 1_024), (0, 40)):
        monkeypatch.setattr(lines_module, "PAIRS", pairs)
        monkeypatch.setattr(cells, "TILE_ROWS", rows)
        monkeypatch.setattr(lines_module, "pinned", counted)
        made.clear()
        found.append(sorted(map(tuple, line_groups(documents(*enumerate(lines))).collect())))
        assert pairs > 16 or max(made) < 4 * many
    assert len(found[0]) > 100
    # A group has the same lines, whatever its links.
    assert found[0] == found[1] == found[2]


def test_odd_rows(documents):
    long = "z" * 100_000
    rows = [(3, "a line here\n\nb\nA"), (1, "b\n \na line here"), (2, None), (4, ""), (5, "b"), (5, "b"), (None, "A"), (6, long), (7, long + "z")]
    out = sorted(((r.doc_id, r.n_lines, r.kept_lines, r.text) for r in dedup_lines(documents(*rows), with_text=True).collect()), key=str)
    assert out == sorted(
        [
            (1, 3, [0, 1, 2], "b\n \na line here"), (2, 0, [], None), (3, 4, [1, 3], "\nA"), (4, 1, [0], ""),
            (5, 1, [], ""), (5, 1, [], ""), (None, 1, [], ""), (6, 1, [0], long), (7, 1, [], ""),
        ],
        key=str,
    )


def test_no_rows(documents):
    assert dedup_lines(documents().limit(0)).count() == 0
    assert line_groups(documents((1, "x"))).count() == 0


def test_polynomials_from_halves():
    codes = np.random.default_rng(3).integers(0, 2**63, 40).astype(np.uint64)
    for size in (1, 2, 3, 7, 8, 13, 40, 41):
        plain = np.zeros(max(0, len(codes) - size + 1), np.uint64)
        for k in range(size if len(plain) else 0):
            plain = plain * _K + codes[k : len(codes) - size + 1 + k]
        assert (_rolled(codes, size) == plain).all()


def test_long_path_is_one_component(spark):
    """Many rounds: what a plan estimates of its size must not grow with them."""
    links = spark.range(300).selectExpr("id * 7919 % 301 AS a", "(id + 1) * 7919 % 301 AS b")
    out = components(links)
    assert {r.component for r in out.collect()} == {0} and out.count() == 301
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
