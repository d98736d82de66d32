"""From raw documents to an ordered training mix: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Null, empty and very long texts, repeated rows, empty tables and further
columns of any name pass through as each stage says. Stages can be chained without writing
between them: what a stage staged in the shared folder lasts as long as some DataFrame is made of
it (a later stage then deletes it), and in run() until the stage's result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, mixing, pii, quality, simhash
from larkspur.llm.common import read, release, shared_dir, staging


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base limits and are no outliers of their language and source.

    Null and empty texts have no words and go. Repeated rows are judged alike. An empty table stays empty.
    """
    release(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least doc_id's, nulls last.

    Texts without words are one group. Of rows with equal ids any one, by a fixed row number, stays.
    """
    release(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows less than a twentieth of whose words stand in a passage of the benchmark table.

    Null and empty texts stay; repeated rows are judged alike; an empty benchmark keeps every row.
    """
    release(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data and secrets masked and n_chars renewed; null and empty texts stay as they are."""
    release(spark)
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the mix, with its number, the words taken and the position, sorted by position.

    Texts without words are not taken; a null source is a source.
    """
    release(spark)
    return mixing.training_order(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mix)]

#: Fingerprint bits, suffix searches and robust covariances are not expressible in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the last stage's rows, sorted by position."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs.orderBy("position")  # files are read in any order
