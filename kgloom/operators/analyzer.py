"""Questions before they are answered: spelling against the values of tables, parts, identifiers, and pronouns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shorter words are taken as they are; identifiers; words that stand for what was named before; words that make a question one about tables: fixed values.
LEAST = 4
IDENTIFIER = r"^[A-Z]+-[0-9]+$"
PRONOUNS = ["it", "its", "this", "that", "they", "them"]
TABULAR = ["total", "amount", "average", "count", "sum", "many"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s,?!]+"), lambda w: w != "")


def deletions(word: Column) -> Column:
    """The word and what is left when one letter is taken out of it: two words at most one edit apart share one of these."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def vocabulary(values: DataFrame, value: str) -> DataFrame:
    """(word, n): the words of at least LEAST letters in ``values``, lower-cased, with how many values hold them."""
    w = values.select(F.explode(F.array_distinct(F.transform(words(F.col(value)), F.lower))).alias("word"))
    return w.where((F.length("word") >= LEAST) & F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corrections(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(word, right) for the distinct words of ``asked`` (word) that ``known`` (word, n) hasn't and that are one edit (an insertion, deletion, substitution)
    from one it has: the most frequent one, the first in order among equals.

    Words meet by their deletions, a letter less on either side, so no word is compared with the whole vocabulary; a key that
    very many words share is one of few letters, which are left out."""
    wrong = asked.select("word").distinct().join(known.select("word"), "word", "left_anti").where((F.length("word") >= LEAST) & F.col("word").rlike("^[a-z]+$"))
    near = wrong.select("word", F.explode(deletions(F.col("word"))).alias("key")).join(known.select(F.col("word").alias("right"), "n", F.explode(deletions(F.col("word"))).alias("key")), "key")
    near = near.where(F.levenshtein("word", "right") <= 1).select("word", "right", "n").distinct()
    return near.groupBy("word").agg(F.min_by("right", F.struct(-F.col("n"), "right")).alias("right"))


def analyzed(turns: DataFrame, known: DataFrame, keys: list[str], order: list[str], question: str) -> DataFrame:
    """``turns`` with ``corrected``, ``parts``, ``identifiers``, ``refers_to`` and ``route``.

    Words are corrected against ``known``; a question is cut at ``?`` and `` and ``; identifiers stay as they are; a question with a pronoun and without an identifier of
    its own refers to the last identifier in the turns before it (by ``order`` within ``keys``). The route is TABULAR if a word asks for a number.

    Defined results: a null question is empty; turns without a known order among each other are ambiguous to the reader, not to
    this: ``order`` has to tell them apart."""
    t = turns.withColumn("_id", F.struct(*keys, *order)).withColumn("_q", F.coalesce(F.col(question), F.lit("")))
    spoken = t.select("_id", F.posexplode(F.split("_q", " ")).alias("_at", "_w"))
    bare = F.lower(F.regexp_replace("_w", r"[,?!]+$", ""))
    spoken = spoken.withColumn("word", F.when(~F.regexp_replace("_w", r"[,?!]+$", "").rlike(IDENTIFIER), bare))
    fixed = spoken.join(corrections(spoken.where("word IS NOT NULL"), known), "word", "left")
    out = F.when(F.col("right").isNotNull(), F.concat("right", F.regexp_extract("_w", r"([,?!]*)$", 1))).otherwise(F.col("_w"))
    line = fixed.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", out.alias("w")))), lambda x: x["w"]), " ").alias("corrected"))
    said = t.join(line, "_id")
    every = words(F.col("corrected"))
    said = said.withColumn("_ids", F.filter(every, lambda w: w.rlike(IDENTIFIER)))
    before = F.last(F.when(F.size("_ids") > 0, F.element_at("_ids", -1)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    pronoun = F.exists(every, lambda w: F.lower(w).isin(*PRONOUNS))
    parts = F.filter(F.transform(F.split("corrected", r"\?| and "), lambda p: F.trim(p)), lambda p: p != "")
    return said.select(
        *turns.columns,
        "corrected",
        parts.alias("parts"),
        F.col("_ids").alias("identifiers"),
        F.when(pronoun & (F.size("_ids") == 0), before).alias("refers_to"),
        F.when(F.exists(every, lambda w: F.lower(w).isin(*TABULAR)), "TABULAR").otherwise("VECTOR").alias("route"),
    )
