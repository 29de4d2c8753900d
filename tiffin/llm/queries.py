"""Registered corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.llm import (
    bpe,
    decontam,
    exact,
    jaccard,
    language,
    lines,
    mixing,
    negatives,
    repeats,
    secret_scan,
    sharding,
    spelling,
    tokens,
)
from tiffin.llm.common import new_folder, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(function):
    LLM_QUERIES[function.__name__] = function
    return function


#: Vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the vocabulary of byte_bpe_50k cuts text into pieces.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@query
def op1_token_counts(spark, sf_dir, tokenizers=TOKENIZERS):
    """Totals after four batches over all documents: word counts and estimates of the byte-pair counts are
    inserted, the estimates revised by the tokenizer, the word counts deleted, and the revision sent again."""
    docs = table(spark, sf_dir, "documents")
    totals = tokens.TokenTotals(spark, new_folder(spark, "token-totals"))
    words = tokens.counted(docs, "words/1", tokens.word_counter)
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    guess = docs.select(
        "doc_id", "source", "lang", F.lit("byte_bpe_50k/1").alias("tokenizer"), F.ceil(length / 4).alias("n_tokens")
    )
    bpe = tokens.bpe_counter(f"{tokenizers}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN)
    exact_counts = tokens.counted(docs, "byte_bpe_50k/1", bpe).withColumn("op", F.lit("revise"))
    totals.apply(1, words.unionByName(guess).withColumn("op", F.lit("insert")))
    totals.apply(2, exact_counts)
    totals.apply(3, words.withColumn("op", F.lit("delete")))
    totals.apply(2, exact_counts)
    return totals.totals()


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard.linked_groups(table(spark, sf_dir, "documents"), 3, 90)


@query
def op3_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


LLM_ORACLES["op3_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op4_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents")).drop("spans")


@query
def op5_sharding(spark, sf_dir):
    shards = sharding.minimax_shards(table(spark, sf_dir, "documents"), 16)
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query
def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


# The excess is shared anew round by round: what is above its cap is clamped, the rest share what is left.
LLM_ORACLES["op6_mixing"] = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{mixing.SEED}:' || CAST(doc_id AS VARCHAR)) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM rows GROUP BY source
), rounds AS (
  SELECT 0 AS turn, source, source_size, weight, false AS capped, false AS newly FROM sources
  UNION ALL
  SELECT turn + 1, source, source_size, weight, capped OR above, above AND NOT capped
  FROM (
    SELECT *, weight * (sum(source_size) OVER () * 1.5::DOUBLE
                        - coalesce(sum(source_size * 2.0::DOUBLE) FILTER (capped) OVER (), 0.0::DOUBLE))
              / nullif(sum(weight) FILTER (NOT capped) OVER (), 0) >= source_size * 2.0::DOUBLE AS above,
           bool_or(newly) OVER () OR turn = 0 AS open
    FROM rounds
  ) WHERE open
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN source_size * 2.0::DOUBLE
              ELSE weight * ((sum(source_size) OVER () * 1.5::DOUBLE
                              - coalesce(sum(source_size * 2.0::DOUBLE) FILTER (capped) OVER (), 0.0::DOUBLE))
                             / sum(weight) FILTER (NOT capped) OVER ()) END AS target
  FROM rounds WHERE turn = (SELECT max(turn) FROM rounds)
), fill AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, round(t.target) AS aim,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       -- words of the endless repetition of the source, cut after the aim, that fall into this document
       CAST(least(size, greatest(0, aim - before))
            + least(size, greatest(0, aim - source_size - before)) AS BIGINT) AS taken
FROM fill
"""


@query
def op7_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


@query
def op8_secret_scans(spark, sf_dir):
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
        secret_scan.as_text(spans).alias("spans"),
    )


@query
def op10_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_suffix_array_dedup(spark, sf_dir):
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.grouped_spellings(table(spark, sf_dir, "documents"))


@query
def op12_byte_bpe(spark, sf_dir, tokenizers=TOKENIZERS):
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, BYTE_BPE_PATTERN)


@query
def op11_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


LLM_ORACLES["op11_hard_negatives"] = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.r <> c.r
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS nth
  FROM scored WHERE same QUALIFY nth <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
