"""A corpus from raw documents to token ids: five stages, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``docs`` unchanged. Nulls, empty tables, repeated rows and extra columns are treated as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, decontaminate, exact_dedup, near_dup, toxicity
from spanloom.llm.common import table
from spanloom.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model learns from the labels of the learnable fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the longest, then the one of smallest id."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the document of smallest id."""
    return near_dup.keep(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digest of the ids and of the bytes they decode to, for every document left."""
    return bpe.report(bpe.encode(docs, bpe.share(spark)))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_benchmark), ("bpe", tokenize)]

#: Toxicity scores and near-duplicate classes have no SQL form; the tests compare with plain versions.
ORACLE_SQL = None


#: Rows that go to a Python worker at once; whole texts are wide, and both sides hold a batch or two.
BATCH_ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, BATCH)
    try:
        for _, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return docs
