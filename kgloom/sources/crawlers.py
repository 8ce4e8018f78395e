"""Checkpointed crawlers as Python data sources.

``register(spark)`` adds the format ``folder_crawl``: a listing of files under a
folder with their modification times. As a batch source it reads all; as a
stream its offset is the newest modification time seen and the files that have it, which Structured
Streaming keeps in the checkpoint, so a run continues where the last one stopped and a file that
appears later with the same time is still new. A folder that can't be read fails the run, so that the
offset never passes it; ``skip_failed`` leaves it out instead. A listing is one task: it waits for a
directory, not for data.
Remote drives plug in by another ``listing`` of (id, folder, name, modified, size).

``paged_listing`` is a stream over listings that come in pages: its offset is the token of each folder's next page.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, folder string, name string, modified long, size long"


def folder_listing(options: dict) -> Iterator[tuple]:
    """Files under ``root`` with a name that ends in ``suffix``."""

    def failed(error: OSError) -> None:
        if options.get("skip_failed", "false") != "true":
            raise error

    for folder, _, names in os.walk(options["root"], onerror=failed):
        for n in sorted(names):
            if n.endswith(options.get("suffix", "")):
                path = os.path.join(folder, n)
                s = os.stat(path)
                yield (os.path.relpath(path, options["root"]), folder, n, int(s.st_mtime_ns // 1000), s.st_size)


LISTINGS: dict[str, Callable[[dict], Iterator[tuple]]] = {"folder": folder_listing}


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(None)]

    def read(self, partition):
        yield from LISTINGS[self.options.get("listing", "folder")](self.options)


class StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"modified": 0, "seen": []}

    def after(self, start):
        return [r for r in LISTINGS[self.options.get("listing", "folder")](self.options) if r[3] > start["modified"] or (r[3] == start["modified"] and r[0] not in start["seen"])]

    def read(self, start):
        rows = self.after(start)
        newest = max([start["modified"], *(r[3] for r in rows)])
        seen = [r[0] for r in rows if r[3] == newest] + (start["seen"] if newest == start["modified"] else [])
        return iter(rows), {"modified": newest, "seen": sorted(seen)}

    def readBetweenOffsets(self, start, end):
        return iter([r for r in self.after(start) if r[3] < end["modified"] or (r[3] == end["modified"] and r[0] in end["seen"])])


class FolderCrawl(DataSource):
    @classmethod
    def name(cls):
        return "folder_crawl"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))

    def simpleStreamReader(self, schema):
        return StreamReader(dict(self.options))


PAGE_SCHEMA = "id string, folder string, name string, modified string, size long"


class RecordedPages:
    """A remote listing's answers as files ``root/<folder>/<token>.json``: what a page request returns, with ``value`` (items), and
    ``next`` or ``delta`` (the token of the page after it, which may not be there yet). A page with ``error`` couldn't be read."""

    def __init__(self, options: dict):
        self.root = options["root"]

    def folders(self) -> list[str]:
        return sorted(f for f in os.listdir(self.root) if os.path.isdir(os.path.join(self.root, f)))

    def page(self, folder: str, token: str) -> dict | None:
        path = os.path.join(self.root, folder, f"{token}.json")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return json.load(f)


#: Clients by name: a remote one has the same two methods.
CLIENTS: dict[str, Callable[[dict], RecordedPages]] = {"recorded": RecordedPages}
FIRST_TOKEN = "0"


def after(page: dict, token: str) -> str:
    """The token of the page after this one; the last of a listing without changes to come has an end of its own."""
    return page.get("next") or page.get("delta") or f"{token} end"


@dataclass
class FolderPages(InputPartition):
    folder: str
    start: str
    end: str


class PageStreamReader(DataSourceStreamReader):
    """A stream whose offset is the token of the next page of each folder. A batch goes as far as pages can be read: a folder whose
    page fails keeps its token, so the next run tries it again, while the others go on. Each folder is a partition."""

    def __init__(self, options: dict):
        self.options, self.client = options, CLIENTS[options.get("client", "recorded")](options)
        self.most = int(options.get("pages_per_batch", "1000"))

    def initialOffset(self) -> dict:
        return {"next": {}}

    def latestOffset(self) -> dict:
        # Spark asks for the newest offset without saying where it is: the end of what can be read now
        return {"next": {f: self.reach(f) for f in self.client.folders()}}

    def reach(self, folder: str, token: str = FIRST_TOKEN) -> str:
        for _ in range(self.most):
            page = self.client.page(folder, token)
            if page is None or "error" in page:
                break
            token = after(page, token)
        return token

    def partitions(self, start: dict, end: dict) -> list[FolderPages]:
        return [FolderPages(f, start["next"].get(f, FIRST_TOKEN), token) for f, token in sorted(end["next"].items()) if token != start["next"].get(f, FIRST_TOKEN)]

    def read(self, partition: FolderPages) -> Iterator[tuple]:
        token = partition.start
        while token != partition.end:
            page = self.client.page(partition.folder, token)
            if page is None or "error" in page:
                raise OSError(f"page {token} of {partition.folder} was there when the batch was planned")
            for x in page["value"]:
                yield (x["id"], partition.folder, x["name"], x.get("modified"), x.get("size"))
            token = after(page, token)

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    @classmethod
    def name(cls):
        return "paged_listing"

    def schema(self):
        return PAGE_SCHEMA

    def streamReader(self, schema):
        return PageStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderCrawl)
    spark.dataSource.register(PagedListing)
