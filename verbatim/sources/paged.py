"""A Python data source over paged JSON services: a partition for each start address, pages by their next links.

``fetch`` is any callable (url, params) -> (status, headers, body); tests give a fake one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = frozenset((408, 425, 429, 500, 502, 503, 504))


def fetch_with_retry(fetch: Callable, url: str, params: dict | None = None, attempts: int = 4, base: float = 0.5, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The answer of the first attempt that isn't to be repeated; waits double, or are as asked for, up to ``longest``."""
    for attempt in range(attempts):
        status, headers, body = fetch(url, params or {})
        if status not in RETRIED:
            if status >= 400:
                raise OSError(f"{url}: status {status}")
            return headers, body
        if attempt < attempts - 1:
            asked = str(headers.get("Retry-After", ""))
            sleep(min(longest, float(asked) if asked.isdigit() else base * 2**attempt))
    raise OSError(f"{url}: status {status} after {attempts} attempts")


def pages(fetch: Callable, url: str, most: int = 1000, **retry) -> Iterator[tuple[str, object]]:
    """(address, document) along the links named next; a repeated address or too many pages is an error."""
    seen: set[str] = set()
    while url:
        if url in seen:
            raise ValueError(f"page {url} again")
        if len(seen) >= most:
            raise ValueError(f"more than {most} pages")
        seen.add(url)
        _, body = fetch_with_retry(fetch, url, **retry)
        document = json.loads(body)
        yield url, document
        links = document.get("links", []) if isinstance(document, dict) else []
        following = next((x.get("href") for x in links if x.get("rel") == "next"), None)
        url = urljoin(url, following) if following else ""


class _Start(InputPartition):
    def __init__(self, url: str):
        self.url = url


def paged_source(name: str, fetch: Callable, starts: list[str]) -> type[DataSource]:
    """A data source class to register: rows (start, url, body)."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Start(u) for u in starts]

        def read(self, partition):
            for url, document in pages(fetch, partition.url):
                yield partition.url, url, json.dumps(document, ensure_ascii=False)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "start string, url string, body string"

        def reader(self, schema):
            return Reader()

    return Source
