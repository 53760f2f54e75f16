"""From raw documents to packed training sequences, stage by stage.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs.  All but the last keep the columns of documents.

1. quality: a byte-level network, learned from ``labels.quality``, rejects documents (op9).
2. near copies: of each SimHash component, one row of the smallest id stays (op8).
3. personal data: what is found is replaced by a mark of its kind (op6, its trees trained on the stage's input).
4. mixing: sources are taken to their target weights; documents repeat, and one per source is cut (op4).
5. packing: the pieces of all documents in sequences of 2048 tokens (op5).

Defined results: a null text counts as empty in every decision and stays null until it is packed; rows
decide, not ids, so rows that share an id or have none are kept or dropped each by itself; of rows that are
equal in all columns near_copies keeps one; ties go to the smaller id, then to a digest of the row; an empty
table passes all stages as an empty one; further columns, whatever their names, are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agentlake.llm import op04_mixing, op05_packing, op06_pii, op08_simhash, op09_quality
from agentlake.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = op09_quality.train(docs, table(spark, sf_dir, "labels"))
    return op09_quality.accepted(docs, net)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_simhash.drop_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_packing.pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the network, so the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
