"""A paged, ordered remote scan as a data source.

The remote side gives nodes newest first, in pages with a cursor.  The reader
asks for pages, halves their size when a call times out (down to a floor), grows
it again on success, waits when the quota is used up, completes nested
connections, and stops early: at the first node older than ``since``, or after
``limit`` rows.  Where the remote side is comes from ``transport``, the import
path of a function (query variables -> answer), so that tests need no network.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("transport", "package.module:function").option("since", "...").load()
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, FLOOR = 25, 5
ATTEMPTS, TRANSIENT = 8, 3
NESTED = ("reviews", "reviewThreads", "comments")


class Timeout(Exception):
    """The remote side took too long: a smaller page may pass."""


class Limited(Exception):
    """The quota is used up for ``seconds``."""

    def __init__(self, seconds: float):
        super().__init__(f"limited for {seconds} s")
        self.seconds = seconds


@dataclass
class Pager:
    """Pages of a connection with a page size that adapts, and the state to go on from."""

    transport: Callable[[dict], dict]
    most: int = PAGE
    floor: int = FLOOR
    wait: Callable[[float], None] = time.sleep
    size: int = 0
    cursor: str | None = None
    sizes: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.size = self.size or self.most

    def call(self, variables: dict) -> dict:
        """An answer; waits while the quota is used up, tries again after passing errors."""
        transient = 0
        for attempt in range(ATTEMPTS):
            try:
                return self.transport(variables)
            except Limited as error:
                self.wait(error.seconds)
            except ConnectionError:
                transient += 1
                if transient >= TRANSIENT:
                    raise
                self.wait(2.0**attempt)
        raise ConnectionError("no answer after all attempts")

    def page(self) -> tuple[list[dict], bool]:
        """The next page's nodes, and whether there are more."""
        while True:
            self.sizes.append(self.size)
            try:
                answer = self.call({"connection": "pullRequests", "first": self.size, "after": self.cursor})
            except Timeout:
                if self.size <= self.floor:
                    raise
                self.size = max(self.floor, self.size // 2)
                continue
            self.size = min(self.most, self.size * 2)
            info = answer["pageInfo"]
            self.cursor = info["endCursor"]
            return [self.complete(n) for n in answer["nodes"]], bool(info["hasNextPage"])

    def complete(self, node: dict) -> dict:
        """A node with the rest of its nested connections."""
        for name in NESTED:
            inner = node.get(name)
            if inner:
                self._rest(node["number"], name, inner)
        for thread in (node.get("reviewThreads") or {}).get("nodes") or []:
            if thread.get("comments"):
                self._rest(thread["id"], "threadComments", thread["comments"])
        return node

    def _rest(self, owner, name: str, inner: dict) -> None:
        info = inner.get("pageInfo") or {}
        while info.get("hasNextPage"):
            answer = self.call({"connection": name, "owner": owner, "first": 50, "after": info["endCursor"]})
            inner["nodes"] = [*inner["nodes"], *answer["nodes"]]
            info = inner["pageInfo"] = answer["pageInfo"]


def rows(pager: Pager, since: str | None = None, limit: int | None = None) -> Iterator[dict]:
    """Nodes newest first, until the first that is older than ``since``, or ``limit`` of them."""
    n, more = 0, True
    while more:
        nodes, more = pager.page()
        for node in nodes:
            if since and node["updatedAt"] < since:
                return
            if limit is not None and n >= limit:
                return
            n += 1
            yield node


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "number int, updatedAt string, node string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    """One partition: the order of the remote side and its quota allow no more."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        pager = Pager(getattr(importlib.import_module(module), name), int(self.options.get("pagesize", PAGE)))
        limit = self.options.get("limit")
        for node in rows(pager, self.options.get("since"), int(limit) if limit else None):
            yield node["number"], node["updatedAt"], json.dumps(node)
