"""Readers beyond Spark's own, and a scratch folder for round trips."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="kgloom-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: evaluated once, whatever reads it, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Deletes tables made by ``kept`` once nothing reads them any more."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines; objects are resources or literals."""
    line = spark.read.text(path).where(~F.col("value").startswith("#"))
    part = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
    get = lambda i: F.regexp_extract("value", part, i)
    return line.where(F.col("value").rlike(part)).select(get(1).alias("s"), get(2).alias("p"), F.coalesce(F.nullif(get(3), F.lit("")), get(4)).alias("o"))


def active_dataset(spark: SparkSession, registry: list[dict], name: str) -> DataFrame:
    """The newest version of a logical data set."""
    versions = [r for r in registry if r["name"] == name]
    if not versions:
        raise ValueError(f"no data set is called {name}")
    return spark.read.parquet(max(versions, key=lambda r: r["version"])["path"])


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, bounds: tuple[int, int] | None = None, **options) -> DataFrame:
    """A relational table, read in ``parts`` ranges of ``key`` where bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).withColumn("path", F.col("_metadata.file_path"))


SHEET_NAMES = {"main": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "rel": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def workbook_rows(raw: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row index, cells as text) of an .xlsx file: a zip of XML parts. Shared and inline strings,
    numbers and booleans as written; columns follow the cells' references, gaps are null."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{SHEET_NAMES['main']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("main:si", SHEET_NAMES)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{SHEET_NAMES['main']}}}sheet"):
            part = targets[sheet.get(f"{{{SHEET_NAMES['rel']}}}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            for i, row in enumerate(root.iter(f"{{{SHEET_NAMES['main']}}}row")):
                cells: list[str | None] = []
                for c in row.findall("main:c", SHEET_NAMES):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    v = c.find("main:v", SHEET_NAMES)
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{{{SHEET_NAMES['main']}}}t")))
                    elif v is None or v.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                yield sheet.get("name"), int(row.get("r") or i + 1) - 1, cells


def column_number(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A minimal .xlsx file with inline strings."""
    out = io.BytesIO()
    cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET_NAMES["main"]}" xmlns:r="{SHEET_NAMES["rel"]}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">{"".join(map(cell, r))}</row>' for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{SHEET_NAMES["main"]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def sheets(files: DataFrame) -> DataFrame:
    """Rows (path, sheet, row_index, cells) of ``files`` (path, content), by the path's ending: workbooks
    (.xlsx) with all their sheets, everything else as comma-separated text. A file is one row here, as a workbook
    can't be split; rows of a file leave in batches."""

    def read(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = workbook_rows(raw) if path.lower().endswith((".xlsx", ".xlsm")) else (("Sheet1", i, r) for i, r in enumerate(csv.reader(io.StringIO(raw.decode("utf-8", errors="replace")))))
                while part := list(islice(rows, 10_000)):
                    name, index, cells = zip(*part, strict=True)
                    yield pd.DataFrame({"path": path, "sheet": name, "row_index": index, "cells": cells})

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, row_index int, cells array<string>")


def sheet_files(spark: SparkSession, path: str) -> DataFrame:
    """``sheets`` of all files under ``path``."""
    return sheets(spark.read.format("binaryFile").load(path))
