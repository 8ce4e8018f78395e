"""Quality classifier on supervised subword embeddings (see ``subwords``).

Defined results: null and empty texts score the bias; very long texts are scored
whole, but only texts up to ``longest`` bytes teach; a label row without a value,
or a document whose labels disagree, teaches nothing; a document that repeats
teaches once and has a row for each; without texts of both classes that teach (no
labels, labels of other documents, texts all too long) the score is 0.5 for
all; a null doc_id is scored, teaches nothing and isn't held out; an empty table
gives no rows; other columns, whatever their names, are kept by
``filter_quality`` and ignored by ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import fresh, slim, small_batches
from kgloom.llm.subwords import Model, train

#: The texts that teach are at most this many bytes together; they go to the driver.
MOST_BYTES = 256 << 20


def remainder(key: str, of: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, most_bytes: int = MOST_BYTES) -> tuple[list, list, dict]:
    """Texts and labels of up to ``per_class`` documents of each class with texts of up to ``longest`` bytes, smallest
    hash of the key first, and the shares of the classes. With many classes each has fewer, so that the
    texts stay within ``most_bytes``; more classes than that allows are refused. ``labels``: doc_id and ``label``."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("doc_id", "_y")
    counts = {r["_y"]: r["n"] for r in one.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).orderBy("_y").limit(most_bytes // longest + 1).collect()}
    if len(counts) > most_bytes // longest:
        raise ValueError(f"more than {most_bytes // longest} labels: raise most_bytes to learn them all")
    if not counts:
        return [], [], {}
    total = sum(counts.values())
    each = max(1, min(per_class, most_bytes // longest // len(counts)))
    # only texts that are short enough are chosen from; a share of the hashes holds more than enough of a large class
    fits = docs.where(F.octet_length("text") <= longest).select("doc_id").distinct().join(one, "doc_id").withColumn("_h", F.xxhash64("doc_id", F.lit(11)))
    sizes = fits.groupBy("_y").agg(F.count(F.lit(1)).alias("_m"))
    # a row a class, of which there are few: rows that are too many for a class go before they meet
    near = fits.join(F.broadcast(sizes), "_y").where(F.pmod("_h", F.lit(1 << 30)) * F.col("_m") <= F.lit((2 * each + 100) << 30))
    first = Window.partitionBy("_y").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).select("doc_id", "_y")
    # at most most_bytes / longest keys
    rows = docs.where(F.octet_length("text") <= longest).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["_y"] for r in rows], {y: n / total for y, n in counts.items()}  # classes without a text too


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 65_536) -> Model:
    """Learns ``labels.quality`` from the rows that aren't held out (crc32 of the id mod 3 is not 1),
    at most ``per_class`` of each value with texts up to ``longest`` bytes."""
    rows = labels.where(remainder("doc_id", 3) != 1).select("doc_id", "quality")
    texts, y, priors = labelled_sample(docs, rows, "quality", per_class, longest)
    return train(texts, y, priors, lower=False)


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` of every document with the probability that its quality is 1 as ``name``."""
    one = model.classes.index(1) if 1 in model.classes and len(model.classes) > 1 else None
    schema = docs.select(*keep).schema
    names = [f.name for f in schema]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows from the classes

    def run(batches):
        for batch in batches:
            text = batch.column(len(names))
            p = shared.value.probabilities(text)[:, one] if one is not None else np.full(len(text), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p, pa.float64())], names=[*names, name])

    return small_batches(docs).select(*keep, F.col("text").alias(fresh(docs, "_text"))).mapInArrow(slim(run), schema.add(name, "double"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score ``threshold`` or more, with their columns."""
    name = fresh(docs, "_score")
    return score(docs, fit_quality(docs, labels), docs.columns, name).where(F.col(name) >= threshold).select(*docs.columns)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
