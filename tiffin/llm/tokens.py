"""Token counts as delta-maintained rollups.

A batch of changes inserts, deletes or revises documents under a tokenizer version. Each change becomes signed
rows (documents, tokens): plus what a document has now, minus what the ledger says it had. The signed rows of a
batch, summed by source, language and version, are the batch's delta; totals are sums of deltas.

A store is a folder:

``ledger/batch=N/attempt=X`` current counts of the documents that batch N touched,
``deltas/batch=N/attempt=X`` its summed signed rows,
``commits/batch=N`` one row naming the attempt that counts.

A batch is committed by writing its commit row last, so a batch that was lost half-way leaves nothing that is
read, and one that is applied twice is applied once.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tiffin.llm.common import small_batches

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, gone boolean"


def word_counter():
    return lambda texts: [len(t.split()) for t in texts]


def bpe_counter(path: str, pattern: str):
    """Counts of byte-pair tokens by the ranks in a ``.tiktoken`` file, with the pattern it was made for."""

    def build():
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]

    return build


def counted(docs: DataFrame, tokenizer: str, build) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of every row of ``docs``; null and empty texts have 0 tokens.

    ``build`` makes the counting function, once per task.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = build()
        for batch in batches:
            yield pd.Series(count([t or "" for t in batch]), dtype="int64")

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens("text").alias("n_tokens"))


class TokenTotals:
    """Totals by source, language and tokenizer version, kept in ``folder`` on a file system all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _attempts(self) -> dict[int, str]:
        """Batch number and attempt of every commit: one short row for each batch that was ever applied."""
        try:
            rows = self.spark.read.schema("batch long, attempt string").parquet(f"{self.folder}/commits/*").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r["batch"]: r["attempt"] for r in rows}

    def _read(self, kind: str, schema: str) -> DataFrame:
        folder, schema = f"{self.folder}/{kind}", schema + ", batch long, attempt string"
        paths = [f"{folder}/batch={batch}/attempt={attempt}" for batch, attempt in sorted(self._attempts().items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", folder).schema(schema).parquet(*paths)

    def current(self) -> DataFrame:
        """The newest ledger row of each document and tokenizer that has not been deleted since."""
        newest = Window.partitionBy("doc_id", "tokenizer").orderBy(F.desc("batch"))
        ledger = self._read("ledger", LEDGER).withColumn("_n", F.row_number().over(newest))
        return ledger.filter("_n = 1 AND NOT gone").drop("_n", "batch", "attempt", "gone")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit ``changes`` as ``batch``; False if that batch was committed before.

        ``changes`` has doc_id, source, lang, tokenizer, n_tokens and ``op``: ``insert`` and ``revise`` set a
        document's count under that tokenizer version (an insert of a known document revises it, a revise of
        an unknown one inserts it), ``delete`` takes it out (an unknown one changes nothing). Of several
        changes of a document in a batch the largest (op, n_tokens) decides; equal rows count once. A null
        count is 0; a null doc_id, tokenizer or op makes a change void. Null source or language is a group.
        """
        if batch in self._attempts():
            return False
        attempt = uuid.uuid4().hex
        at = f"batch={batch}/attempt={attempt}"
        first = Window.partitionBy("doc_id", "tokenizer").orderBy(
            F.desc("op"), F.desc("n_tokens"), F.desc("source"), F.desc("lang")
        )
        valid = changes.filter("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('insert', 'revise', 'delete')")
        now = (
            valid.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("long"))
            .withColumn("_n", F.row_number().over(first))
            .filter("_n = 1")
            .select("doc_id", "source", "lang", "tokenizer", "n_tokens", (F.col("op") == "delete").alias("gone"))
        )
        ledger = f"{self.folder}/ledger/{at}"
        now.write.parquet(ledger)
        now = self.spark.read.schema(LEDGER).parquet(ledger)
        before = self.current().join(now.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        signed = now.filter("NOT gone").select(*KEYS, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        signed = signed.unionByName(before.select(*KEYS, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens")))
        delta = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.parquet(f"{self.folder}/deltas/{at}")
        commit = self.spark.createDataFrame([(batch, attempt)], "batch long, attempt string")
        commit.coalesce(1).write.mode("ignore").parquet(f"{self.folder}/commits/batch={batch}")
        return self._attempts().get(batch) == attempt

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens: the sum of all committed deltas; groups without documents are left out."""
        deltas = self._read("deltas", "source string, lang string, tokenizer string, docs long, tokens long")
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 OR n_tokens <> 0")
