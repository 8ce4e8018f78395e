"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next one. All but the last return the columns
of documents.

Defined results, for every stage: an empty table gives no rows; null and empty texts and null ids are documents like others;
columns beside doc_id and text are carried along, whatever their names, and not read; texts of any length are
taken whole; no stage depends on the order of rows or how they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm.common import drop_written, written
from kgloom.llm.decontamination import decontaminate
from kgloom.llm.jaccard import keep_one
from kgloom.llm.packing import pack
from kgloom.llm.pii import redact
from kgloom.llm.quality import filter_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. A null or empty text has the score of the classes' shares; rows that repeat
    are kept or go alike; where no labelled text teaches both classes, nothing is rejected."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Texts without words are near copies of nothing and all
    stay; rows with one id and text are one document; different texts with one id are documents of their own."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; of rows that share an id all go if one
    of them holds an item; rows without an id are told apart by their texts; without items all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null texts stay null; every row is redacted on its own."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. A null or empty text is its closing token alone; rows that repeat are packed
    each on their own; ties of lengths go by what the rows hold."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: A trained classifier and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        drop_written(*before)  # its only reader is done
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
