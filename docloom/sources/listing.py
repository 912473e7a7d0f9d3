"""Paged listings of a document service: a Python data source whose partitions are pages, and what its responses hold.

A response is JSON: ``code`` (0 if all went well), ``message``, and ``data`` with the rows and, for documents and chunks, their number.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Where a response has its rows and their number.
ROWS = {"documents": "docs", "chunks": "chunks"}
PAGE_SIZE = 100
_DOCUMENT = "id string, name string, size string, type string, run string, chunk_count string, token_count string, progress string, create_time string"


def request(url: str, token: str | None, page: int, size: int, tries: int = 3, timeout: float = 30.0) -> str:
    """The body of a page; tried again, after a pause, where the service is busy or away."""
    at = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode({'page': page, 'page_size': size})}"
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(at, headers={"Authorization": f"Bearer {token}"} if token else {}), timeout=timeout) as r:
                return r.read().decode()
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == tries - 1:
                raise
        except OSError:
            if k == tries - 1:
                raise
        time.sleep(0.2 * 2**k)
    raise AssertionError


class ListingSource(DataSource):
    """``spark.dataSource.register(ListingSource)``, then ``spark.read.format("listing").option("url", ...)``, with ``token``, ``page_size``
    and ``kind`` (documents, chunks) as further options. A row for each page: its number and body."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.token, self.size = options["url"], options.get("token"), int(options.get("page_size", PAGE_SIZE))
        self.rows = ROWS[options.get("kind", "documents")]

    def partitions(self) -> list[Page]:
        """As many pages as the service says that there are rows; one row is asked for to learn that."""
        data = (json.loads(request(self.url, self.token, 1, 1)).get("data") or {}) if self.url else {}
        total = data.get("total", data.get("total_datasets", 0)) if isinstance(data, dict) else len(data)
        return [Page(k) for k in range(1, max(1, -(-int(total or 0) // self.size)) + 1)]

    def read(self, page: Page) -> Iterator[tuple[int, str]]:
        yield page.number, request(self.url, self.token, page.number, self.size)


def _number(c: Column) -> Column:
    """Whole numbers alone count; anything else is 0."""
    return F.coalesce(F.when(c.rlike(r"^-?[0-9]+$"), c).try_cast("long"), F.lit(0).cast("long"))


def documents_of(responses: DataFrame) -> DataFrame:
    """``page, id, name, size, type, run, chunk_count, token_count, progress, create_time`` of all documents in ``responses(page, body)``;
    a body that isn't such a response gives none."""
    rows = F.from_json(F.get_json_object("body", "$.data.docs"), f"array<struct<{', '.join(x.replace(' ', ':') for x in _DOCUMENT.split(', '))}>>")
    d = responses.select("page", F.explode(rows).alias("d")).where("d.id is not null and d.name is not null").select("page", "d.*")
    return d.select(
        "page", "id", "name", _number(F.col("size")).alias("size"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("run", F.lit("UNSTART")).alias("run"), _number(F.col("chunk_count")).cast("int").alias("chunk_count"),
        _number(F.col("token_count")).cast("int").alias("token_count"), F.coalesce(F.col("progress").try_cast("double"), F.lit(0.0)).alias("progress"), _number(F.col("create_time")).alias("create_time"),
    )


def errors_of(responses: DataFrame) -> DataFrame:
    """``page, code, message`` of the responses that tell of an error, or can't be read."""
    code = F.get_json_object("body", "$.code").try_cast("int")
    return responses.where(~F.coalesce(code == 0, F.lit(False))).select("page", F.coalesce(code, F.lit(-1)).alias("code"), F.coalesce(F.get_json_object("body", "$.message"), F.lit("not a response")).alias("message"))
