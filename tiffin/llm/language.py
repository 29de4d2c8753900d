"""Language identification of mixed-language text.

Letters are assigned to scripts by code point ranges; a word's script narrows the languages it may have to
those whose training text uses that script. Character trigrams score each word under each language, and a
Viterbi pass with a penalty for each change of language labels the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import small_batches
from tiffin.llm.shingles import letters, mix, runs, slices

UNDETERMINED = "und"
#: Labelled rows per language that the model is fitted on, at most in expectation.
FIT_ROWS = 3_000
#: Hash buckets of trigrams: the model has this many rows and one column per language.
BUCKETS = 1 << 16
#: What a change of language costs, in nats. About the evidence of two distinctive words.
SWITCH = 12.0
#: What a word costs under a language that doesn't use its script.
FOREIGN = 40.0
#: Characters of the texts that one Viterbi pass holds (or one text, if longer).
PASS_CHARS = 4_000_000

# First code points of script ranges.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3130, "hangul"),
    (0x3190, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_RANGE_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
_RANGE_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages, whether a language uses a script


def words_of(texts: list[str]):
    """Code points, trigram buckets, word starts and ends, scripts and the text of each word."""
    table = letters()
    codes, offsets = table.codes(texts)
    inside = table.letter[codes]
    starts, ends = runs(inside)
    shown = np.where(inside, codes, 0).astype(np.uint64)
    grams = np.zeros(len(codes), np.uint64)
    grams[1:-1] = (shown[:-2] << np.uint64(42)) | (shown[1:-1] << np.uint64(21)) | shown[2:]
    if len(codes) > 1:
        grams[0] = (shown[0] << np.uint64(21)) | shown[1]
    buckets = (mix(grams) % np.uint64(BUCKETS)).astype(np.int64)
    scripts = _RANGE_SCRIPT[np.searchsorted(_RANGE_STARTS, codes[starts], "right") - 1]
    return inside, buckets, starts, ends, scripts, np.searchsorted(starts, offsets), offsets


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram and script counts per language of labelled texts; scripts have negative buckets."""
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            texts = part["text"].tolist()
            for begin, end in slices(texts):
                inside, buckets, starts, ends, scripts, _, _ = words_of(texts[begin:end])
                counts = np.bincount(buckets[inside], minlength=BUCKETS)
                seen = np.flatnonzero(counts)
                used = np.bincount(scripts, ends - starts, minlength=len(SCRIPTS)).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "lang": lang,
                        "bucket": np.concatenate([seen, -1 - np.arange(len(SCRIPTS))]),
                        "n": np.concatenate([counts[seen], used]),
                    }
                )


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, script_share: float = 0.02) -> Model:
    """A model of the languages in ``labelled`` (doc_id, text, lang); rows with a null in lang or text don't count.

    Of each language, a hash of the id picks the rows to learn from, so that about ``fit_rows`` are read
    (all, if there are no more). The result has BUCKETS numbers per language, whatever the input.
    """
    known = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    wide = 1 << 30
    keep = F.lit(False)
    for lang in languages:
        part = min(wide, fit_rows * wide // sizes[lang])
        place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(wide))
        keep = keep | ((F.col("lang") == lang) & (place < part))
    counted = known.filter(keep).select("text", "lang").mapInPandas(_count, "lang string, bucket long, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    for n, lang in enumerate(languages):
        own = summed[summed["lang"] == lang]
        bucket, many = own["bucket"].to_numpy(), own["n"].to_numpy()
        counts[bucket[bucket >= 0], n] = many[bucket >= 0]
        scripts[-1 - bucket[bucket < 0], n] = many[bucket < 0]
    logp = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS))
    uses = scripts >= script_share * np.maximum(1, scripts.sum(axis=0))
    return Model(languages, logp, uses)


def word_scores(model: Model, buckets, starts, ends, scripts) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word under each language, the best of a word being 0; and whether it is known there.

    A language knows a word if it uses its script and has its trigrams, on geometric average, no less often than if all
    buckets were equally frequent.
    """
    n = len(starts)
    if not n:
        return np.zeros((0, len(model.languages))), np.zeros((0, len(model.languages)), bool)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.repeat(starts - first, lengths) + np.arange(lengths.sum())
    scores = np.add.reduceat(model.logp[buckets[at]], first, axis=0)
    allowed = model.uses[scripts]
    known = allowed & (scores >= -np.log(BUCKETS) * lengths[:, None])
    narrowed = allowed.any(axis=1)
    scores = scores - np.where(narrowed[:, None] & ~allowed, FOREIGN, 0.0)
    scores -= scores.max(axis=1, keepdims=True)
    scores[~narrowed] = 0.0  # a script that no language uses says nothing
    return scores, known


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of every word: for each text, the best sequence under scores and a penalty per change.

    All texts advance together, one word a step; ``offsets`` says where each begins. Ties go to the smaller
    label, and to no change.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begins = offsets[:-1][order]
    ascending = -sizes[order]
    wide = np.min_scalar_type(scores.shape[1])
    came = np.empty(scores.shape, wide)
    labels = np.empty(len(scores), wide)
    own = np.arange(scores.shape[1], dtype=wide)
    best = np.zeros((len(sizes), scores.shape[1]))
    steps = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(ascending, -np.arange(steps), "left")  # texts longer than the step
    for step in range(steps):
        n = active[step]
        at = begins[:n] + step
        now = best[:n]
        if step:
            top = now.argmax(axis=1)
            jump = now[np.arange(n), top] - switch
            stay = now >= jump[:, None]
            came[at] = np.where(stay, own, top[:, None].astype(wide))
            now = np.where(stay, now, jump[:, None])
        best[:n] = now + scores[at]
    last = best.argmax(axis=1).astype(wide)
    for step in range(steps - 1, -1, -1):
        n = active[step]
        at = begins[:n] + step
        labels[at] = last[:n]
        if step:
            last[:n] = came[at, last[:n]]
    return labels


def _label(texts: list[str], model: Model, switch: float):
    """Per text: language, share of its letters in words that have and fit it, share in words that fit theirs, spans."""
    prepared = [words_of(texts[b:e]) for b, e in slices(texts)]
    scores, known, sizes, shift = [], [], [], 0
    for _, buckets, starts, ends, scripts, words, _ in prepared:
        score, knows = word_scores(model, buckets, starts, ends, scripts)
        scores.append(score)
        known.append(knows)
        sizes.append(np.diff(words))
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    labels = viterbi(np.concatenate(scores), offsets, switch)
    known = np.take_along_axis(np.concatenate(known), labels[:, None].astype(np.int64), axis=1)[:, 0]
    for _, _, starts, ends, _, words, begins in prepared:
        own, sure = labels[shift : shift + len(starts)], known[shift : shift + len(starts)]
        shift += len(starts)
        for d in range(len(words) - 1):
            a, b = words[d], words[d + 1]
            if a == b:
                yield UNDETERMINED, 0.0, 0.0, []
                continue
            weight = np.bincount(own[a:b], ends[a:b] - starts[a:b], minlength=len(model.languages))
            cuts = np.concatenate(([a], a + 1 + np.flatnonzero(np.diff(own[a:b])), [b]))
            spans = [
                {
                    "begin": int(starts[x] - begins[d]),
                    "stop": int(ends[y - 1] - begins[d]),
                    "lang": model.languages[own[x]],
                }
                for x, y in zip(cuts[:-1], cuts[1:])
            ]
            top = int(weight.argmax())
            fits = np.bincount(own[a:b], (ends[a:b] - starts[a:b]) * sure[a:b], minlength=len(model.languages))
            yield model.languages[top], float(fits[top] / weight.sum()), float(fits.sum() / weight.sum()), spans


PREDICTED = "lang_pred string, score double, known double, spans array<struct<begin int, stop int, lang string>>"


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, into: str = "predicted") -> DataFrame:
    """``docs`` (any columns) with ``into``, a struct of lang_pred, score, known and spans, from the text alone.

    A span has code point offsets (stop exclusive) from its first to its last letter. ``lang_pred`` has most
    letters, ``score`` is the share of all letters in words that have this language and that it knows (``word_scores``);
    ``known`` is the share in words that their own span's language knows. Texts that are null or hold no letter, and all texts under a
    model without languages, are ``und`` with score and known 0.
    """
    small_batches(docs.sparkSession)
    # Arrays and names, no class of this package: workers need not have it installed.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.uses))

    @F.pandas_udf(PREDICTED)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch]
            out: list[tuple] = []
            for begin, end in slices(texts, PASS_CHARS):
                if model.languages:
                    out += _label(texts[begin:end], model, switch)
                else:
                    out += [(UNDETERMINED, 0.0, 0.0, [])] * (end - begin)
            yield pd.DataFrame(out, columns=["lang_pred", "score", "known", "spans"])

    return docs.withColumn(into, labelled("text"))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row of ``docs``, learned from the rest's labels."""
    model = fit(docs.filter(~held_out()), fit_rows)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), *[f"predicted.{c}" for c in ("lang_pred", "score", "spans")])


def accepted(docs: DataFrame, least_known: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the documents of no language: no letters, or less than ``least_known`` of them in known words.

    A word is known to the language of its span by script and trigrams, so text of several languages stays, and text in
    a script that no language uses or of random letters goes. The model is learned from the labelled rows of
    ``docs``; without any, only documents with letters stay. All columns are kept.
    """
    model = fit(docs, fit_rows)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    into = "predicted"
    while into in {c.lower() for c in docs.columns}:
        into = "_" + into
    marked = predict(docs, model, into=into)
    clear = (F.col(f"{into}.lang_pred") != UNDETERMINED) & (F.col(f"{into}.known") >= least_known)
    return marked.filter(clear).drop(into)
