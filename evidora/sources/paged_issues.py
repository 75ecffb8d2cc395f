"""A paged issue search as a Spark data source, for batches and streams.

``option("server", "package.module:factory")`` names what talks to the tracker: a callable that takes the options and
gives an object with ``search(query, token, size)`` -> {"issues": [...], "nextPageToken": ..., "isLast": ...}, ``issue(key)`` -> issue or
None, and ``comments(key)`` -> list. It is made anew wherever it is used, so options are all it holds.

Rows are (key, raw): the issue as JSON, with the answer of the comments call at ``fields.comment.comments`` if ``comments`` is true.
A batch gives up to ``max_results`` issues of ``query``, or the one of ``key``, whose absence is an error. A stream has
no cap; its offset is the token of a page and how many of that page's issues were read, so that a page that fills up later gives the rest. Its
tasks fetch a page each, or where there are many some pages in a row; the driver follows tokens only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE, MOST = 100, 200
#: Tasks of a batch up to which every page is one of its own.
TASKS = 200


def connect(options: dict[str, str]):
    module, name = options["server"].split(":")
    return getattr(import_module(module), name)(options)


def pages(server, query: str, size: int, token: str | None = None) -> Iterator[tuple[str | None, list[dict]]]:
    """(token, issues) of one page after the other."""
    while True:
        got = server.search(query, token, size)
        yield token, got.get("issues", [])
        following = got.get("nextPageToken")
        if not following or got.get("isLast", False):
            return
        token = following


def row(server, issue: dict, comments: bool) -> tuple[str, str]:
    if comments:
        fields = dict(issue.get("fields") or {})
        issue = issue | {"fields": fields | {"comment": {"comments": server.comments(issue["key"])}}}
    return issue["key"], json.dumps(issue, ensure_ascii=False)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.query, self.key = options.get("query", ""), options.get("key")
        self.size, self.most = int(options.get("page", PAGE)), int(options.get("max_results", MOST))
        self.comments = str(options.get("comments", "false")).lower() == "true"


class PageRange(InputPartition):
    """Issues of ``pages`` pages in a row, on the first from ``begin`` on, on the last to before ``end`` (None: its end)."""

    def __init__(self, token: str | None, begin: int, end: int | None, pages: int = 1):
        self.token, self.begin, self.end, self.pages = token, begin, end, pages


class IssueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.asked = _Options(options)

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        """Pages follow each other by token, so one task walks them; the cap bounds it."""
        a, server, n = self.asked, connect(self.asked.options), 0
        if a.key:
            found = server.issue(a.key)
            if found is None:
                raise ValueError(f"no issue {a.key}")
            yield row(server, found, a.comments)
            return
        if a.most <= 0:
            return
        for _, issues in pages(server, a.query, min(a.size, a.most)):
            for issue in issues:
                yield row(server, issue, a.comments)
                n += 1
                if n == a.most:
                    return


class IssueStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.asked = _Options(options)
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"token": None, "read": 0}

    def latestOffset(self) -> dict:
        """Where the search ends now; found by following tokens from the last end that this reader knows."""
        at = self.known or self.initialOffset()
        for token, issues in pages(connect(self.asked.options), self.asked.query, self.asked.size, at["token"]):
            at = {"token": token, "read": len(issues)}
        self.known = at
        return at

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        a, tokens = self.asked, []
        if start == end:
            return []
        for token, _ in pages(connect(a.options), a.query, a.size, start["token"]):
            tokens.append(token)
            if token == end["token"]:
                break
        else:
            raise ValueError(f"the search no longer leads from {start} to {end}")
        each = -(-len(tokens) // TASKS)
        return [PageRange(tokens[i], 0 if i else start["read"], end["read"] if i + each >= len(tokens) else None, min(each, len(tokens) - i)) for i in range(0, len(tokens), each)]

    def read(self, partition: PageRange) -> Iterator[tuple[str, str]]:
        a = self.asked
        server = connect(a.options)
        for n, (_, issues) in enumerate(pages(server, a.query, a.size, partition.token), 1):
            for issue in issues[partition.begin if n == 1 else 0 : partition.end if n == partition.pages else None]:
                yield row(server, issue, a.comments)
            if n == partition.pages:
                return
        raise ValueError(f"the search no longer leads on from {partition.token}")

    def commit(self, end: dict) -> None:
        pass


class PagedIssues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_issues"

    def schema(self) -> str:
        return "key string, raw string"

    def reader(self, schema) -> IssueReader:
        return IssueReader(self.options)

    def streamReader(self, schema) -> IssueStreamReader:
        return IssueStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedIssues)
