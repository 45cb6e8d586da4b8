"""A training corpus from raw documents: five stages, each one operator over all that the stage before kept.

Every stage's result is written as Parquet to the shared folder and read again as the next one's documents,
so a lost executor costs at most the stage at work. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, jaccard, langid, mixing, tokenfile
from quarry.llm.common import stored
from quarry.llm.queries import table, tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language of their own: no letters, or no language with half of the text."""
    return langid.keep_identified(docs, least=0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: 5-word shingles, similarity 0.8."""
    return jaccard.keep_one(docs, k=5, share=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten consecutive words, or all, of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources' words come to their targets, in shuffled shards."""
    return mixing.mixed(docs, share=1.5, epochs=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids to ORC and returns what the files hold: doc_id, start, n_tokens, ids_crc32."""
    return tokenfile.tokens_round(docs, tokenizer_path(), end_id=1)


STAGES = [("language id", identified), ("n-gram jaccard join", distinct), ("benchmark decontamination", uncontaminated), ("mixing", mixture), ("token file", tokens)]

#: SQL cannot express the first and the last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
