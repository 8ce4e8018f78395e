"""Language identification on averaged hashed subword embeddings (see ``subwords``),
with a rejection threshold calibrated on texts left out of training.

Defined results: null text and text without a letter are ``und`` with score 0;
documents without a language, or without an id, teach nothing; a document that
repeats teaches once and has a row for each; very long texts are read whole, but
only texts up to ``longest`` bytes teach; with no language that a text teaches every
text is ``und``, with one only every text with a letter is of that one; a null doc_id isn't held out; an empty table gives no rows; other columns,
whatever their names, are ignored; ``rejected`` marks scores under the calibrated
threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import slim
from kgloom.llm.quality import labelled_sample, remainder
from kgloom.llm.subwords import Model, train

UNKNOWN = "und"


def fit_language(docs: DataFrame, per_class: int = 800, longest: int = 16_384) -> Model:
    """Learns ``lang`` from the documents that aren't held out (crc32 of the id mod 4 is not 2)."""
    rows = docs.where(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2))
    texts, y, priors = labelled_sample(docs, rows.select("doc_id", "lang"), "lang", per_class, longest)
    return train(texts, y, priors, lower=True, updates=16_000)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows from the languages

    def run(batches):
        model = shared.value
        names = np.array(model.classes, dtype=object)
        for batch in batches:
            text = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            p = model.probabilities(text)
            known = letters & (names[0] is not None)
            lang = np.where(known, names[p.argmax(axis=1)] if len(p) else names[:0], UNKNOWN)
            top = np.where(known, p.max(axis=1) if len(p) else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(top, pa.float64()), pa.array(~known | (top < model.reject_below))], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(slim(run), "doc_id long, lang_pred string, score double, rejected boolean")


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit_language(docs))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
