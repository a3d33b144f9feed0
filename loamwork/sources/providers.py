"""Trace providers as a Spark data source with keyset pages, injectable for tests (SRC-10 to 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A page function: (options, after or None, page size) to rows (id, root_id, created, payload), ordered by id.
Page = Callable[[dict, str | None, int], list[tuple[str, str, str, str]]]
PROVIDERS: dict[str, Page] = {}
PAGE_SIZE = 1000


def register_provider(name: str, page: Page) -> None:
    """Make a provider known by name."""
    PROVIDERS[name] = page


def provider(name: str) -> Page:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS)) or 'none'}")
    return PROVIDERS[name]


class TraceSource(DataSource):
    """spark.read.format("traces").option("provider", ...).load(): one partition per project."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return "id string, root_id string, created string, payload string"

    def reader(self, schema) -> TraceReader:
        return TraceReader(dict(self.options), provider(self.options.get("provider", "")))


class TraceReader(DataSourceReader):
    def __init__(self, options: dict, page: Page):
        self.options, self.page = options, page

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options.get("projects", "default").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        options, after = {**self.options, "project": partition.value}, None
        while True:
            rows = self.page(options, after, PAGE_SIZE)
            yield from rows
            if len(rows) < PAGE_SIZE:
                return
            after = rows[-1][0]


def safe_url(url: str) -> bool:
    """HTTPS to a public host (SRC-22)."""
    import ipaddress
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    host = parts.hostname or ""
    if parts.scheme != "https" or not host or host == "localhost" or host.endswith((".local", ".internal")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return "." in host
