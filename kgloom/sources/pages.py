"""Recorded pages of drive and mailbox listings as tables: the accounts are remote, their answers are JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRIVE = "value array<struct<id: string, name: string, size: bigint, lastModifiedDateTime: string, parentReference: struct<path: string>, file: struct<mimeType: string>, folder: struct<childCount: int>>>"
MAIL = "value array<struct<id: string, subject: string, receivedDateTime: string, `from`: struct<emailAddress: struct<address: string>>, bodyPreview: string>>"


def items(pages: DataFrame, schema: str) -> DataFrame:
    """The entries of ``pages`` (page), each id once: an entry on two pages is the same entry."""
    return pages.select(F.explode(F.from_json("page", schema)["value"]).alias("x")).select(F.col("x.id").alias("id"), "x").dropDuplicates(["id"])


def drive_files(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, folder, name, size, modified of the files in the ``chosen`` folders (folder) or under them. The folders are a
    person's choice and few."""
    files = items(pages, DRIVE).where("x.file is not null")
    path = F.ltrim(F.regexp_replace("x.parentReference.path", "^/drives?(/[^/:]*)*/?root:", ""), F.lit("/"))
    rows = files.select("id", path.alias("folder"), F.col("x.name").alias("name"), F.col("x.size").alias("size"), F.to_timestamp("x.lastModifiedDateTime").alias("modified"))
    c = F.broadcast(chosen.select(F.col("folder").alias("_chosen")).distinct())
    return rows.join(c, (F.col("folder") == F.col("_chosen")) | F.startswith("folder", F.concat("_chosen", F.lit("/"))), "left_semi")


def messages(pages: DataFrame, since: str) -> DataFrame:
    """id, sender, subject, received, preview of messages received from ``since`` on (in UTC)."""
    m = items(pages, MAIL)
    received = F.to_timestamp_ntz(F.regexp_replace(F.col("x.receivedDateTime"), "Z$", ""))
    rows = m.select("id", F.col("x.from.emailAddress.address").alias("sender"), F.col("x.subject").alias("subject"), received.alias("received"), F.col("x.bodyPreview").alias("preview"))
    return rows.where(F.col("received") >= F.lit(since).cast("timestamp_ntz"))
