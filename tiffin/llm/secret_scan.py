"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import small_batches

# The base kinds and their expressions.
KINDS = ["assign", "access", "hex", "github", "npm"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Published token formats: a prefix, 30 characters, and six of a checksum.
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

SPANS = "array<struct<kind string, begin int, stop int>>"


def checksum_holds(match: re.Match) -> bool:
    """Whether the last six characters are the CRC-32 of the thirty before, in base 62."""
    value, digits = zlib.crc32(match[1].encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == match[2]


CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 16),
    "github": (GITHUB, checksum_holds),
    "npm": (NPM, checksum_holds),
}


def automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for keyword in keywords:
            words.add_word(keyword, (kind, len(keyword)))
    words.make_automaton()
    return words


def secrets_in(text: str, words) -> list[tuple[str, int, int]]:
    """(kind, begin, end) in code points, by begin and then kind."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift the hits
        low = text.translate(_ASCII_LOWER)
    found, passed = [], dict.fromkeys(CHECKS, 0)
    for last, (kind, length) in words.iter(low):
        begin = last + 1 - length
        if begin < passed[kind]:  # inside an earlier match of this kind, kept or not
            continue
        pattern, holds = CHECKS[kind]
        match = pattern.match(text, begin)
        if match:
            passed[kind] = match.end()
            if holds(match):
                found.append((kind, begin, match.end()))
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    words = automaton()
    names = ("kind", "begin", "stop")
    for batch in texts:
        yield pd.Series([[dict(zip(names, f)) for f in secrets_in(t or "", words)] for t in batch], dtype=object)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, begin, stop; code points, stop exclusive) of every row of ``docs``.

    Keywords are found in one pass of an Aho-Corasick automaton; the expression of a kind is tried only where
    one of its keywords begins. Long hexadecimal runs have no keyword and are searched for. Matches of a kind
    don't overlap; one that fails its length or checksum still uses up its characters. Null and empty texts
    have no spans. Only doc_id and text are read; equal rows give equal rows.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.pandas_udf(_spans, SPANS)("text").alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:begin:stop`` joined by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string")))
    return F.concat_ws(",", parts)
