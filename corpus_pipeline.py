"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them in order, writing every stage's result as Parquet into the shared folder
and reading it again. All stages but the last return the columns of documents.
Part of the subpackage ``ledgerlake.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, mixing, ngram_join, quality, token_output
from ledgerlake.llm.common import fresh, fresh_prefix, prepare, table, written
from ledgerlake.llm.queries import vocabulary

#: Tokenizer and classifier cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
LEAST_SCORE = 0.3
#: Chunks and words that a tokenising worker remembers: the executors are full from the stages before.
MEMO = (200_000, 20_000)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores under 0.3."""
    prepare(spark)
    score = fresh(docs.columns, "score_")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest, score).where(F.col(score) >= LEAST_SCORE).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that 5-word Jaccard links of 0.8 join: the least
    doc_id (of rows with one id, any one). Documents without words stay."""
    prepare(spark)
    return ngram_join.keep_one_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold 80 % of a benchmark item's shingles."""
    prepare(spark)
    tag = fresh_prefix(docs.columns, "leak_")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), tag)
    return found.where(F.col(tag + "n_items") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or leave documents as the mix of their sources takes them."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids and describe each document from the files."""
    prepare(spark)
    return token_output.token_id_output(docs, vocabulary(), memo=MEMO)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
