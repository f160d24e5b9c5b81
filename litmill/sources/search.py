"""Search and fetch of article records behind an injected client, as a Spark data source.

The source's partitions are buckets of journal and year; the client is any object with ``search(term, start, size)``
-> (ids, total) and ``fetch(ids)`` -> bytes. The option ``client`` names what makes it, as module:function, called with the
option ``path``; ``LandedClient`` serves files. Requests keep to a rate and are repeated when they fail. Nothing here opens
a network connection."""

from __future__ import annotations

import importlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the most ids that one search lets a caller page through.
SEARCH_CAP = 9_999
EMPTY_SET = b"<PubmedArticleSet></PubmedArticleSet>"


class RateLimiter:
    """A token bucket of ``max(1, rate)`` tokens."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0:
            raise ValueError("the rate must be positive")
        self.rate, self.capacity, self.clock, self.sleep = rate, max(1.0, rate), clock, sleep
        self.tokens, self.at, self.lock = self.capacity, clock(), threading.Lock()

    def acquire(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
                self.at = now
                if self.tokens >= 1:
                    self.tokens -= 1
                    return
                wait = (1 - self.tokens) / self.rate
            self.sleep(wait)


def retried(call: Callable, attempts: int = 5, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Repeats a failing call with doubled waits; the last failure is raised."""
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n + 1 == attempts:
                raise
            sleep(first_wait * 2**n)


class Patient:
    """A client whose requests keep to a rate and are repeated when they fail."""

    def __init__(self, client, rate: float | None = None, attempts: int = 5, sleep: Callable[[float], None] = time.sleep):
        self.client, self.attempts, self.sleep = client, attempts, sleep
        self.limiter = RateLimiter(rate, sleep=sleep) if rate else None

    def _ask(self, call: Callable):
        def once():
            if self.limiter:
                self.limiter.acquire()
            return call()

        return retried(once, self.attempts, sleep=self.sleep)

    def search(self, term: str, start: int, size: int) -> tuple[list[str], int]:
        return self._ask(lambda: self.client.search(term, start, size))

    def fetch(self, ids: list[str]) -> bytes:
        return self._ask(lambda: self.client.fetch(ids)) if ids else EMPTY_SET


def search_all(client, term: str, page: int = 500) -> list[str]:
    """All ids of a term, in order and once each; ValueError if a search can't page through them all."""
    ids, total = client.search(term, 0, page)
    if total > SEARCH_CAP:
        raise ValueError(f"{term}: {total} ids, of which a search gives {SEARCH_CAP} at most")
    found = list(ids)
    while ids and len(found) < total:
        ids, _ = client.search(term, len(found), page)
        found += ids
    return list(dict.fromkeys(x.strip() for x in found if x and x.strip()))


def search_year(client, journal: str, year: int, page: int = 500) -> list[str]:
    """Ids of a journal and year; by months, and by days, where a search can't reach them all."""
    def within(date: str, levels: list[list[str]]) -> list[str]:
        term = f'"{journal}"[TA] AND {date}[DP]'
        if not levels or client.search(term, 0, 1)[1] <= SEARCH_CAP:
            return search_all(client, term, page)
        return [x for part in levels[0] for x in within(f"{date}/{part}", levels[1:])]

    return list(dict.fromkeys(within(str(year), [MONTHS, DAYS])))


#: Parts of a year and of a month in a search term.
MONTHS, DAYS = [f"{m:02d}" for m in range(1, 13)], [f"{d:02d}" for d in range(1, 32)]


def numeric_first(pmid: str) -> tuple[int, str]:
    """Numbers by value before other ids by text."""
    return (0, pmid.zfill(20)) if pmid.isdigit() else (1, pmid)


class LandedClient:
    """Serves landed files: ``searches.json`` (term to ids) and ``articles/<id>.xml``."""

    def __init__(self, root: str):
        self.root = Path(root)
        self.searches = json.loads((self.root / "searches.json").read_text())

    def search(self, term: str, start: int, size: int) -> tuple[list[str], int]:
        ids = self.searches.get(term, [])
        return ids[start : start + size], len(ids)

    def fetch(self, ids: list[str]) -> bytes:
        if not ids:
            return EMPTY_SET
        bodies = [p.read_text() for i in ids if (p := self.root / "articles" / f"{i}.xml").exists()]
        return f"<PubmedArticleSet>{''.join(bodies)}</PubmedArticleSet>".encode()


class Bucket(InputPartition):
    def __init__(self, journal: str, terms: list[str], year: int):
        super().__init__((journal, year))
        self.journal, self.terms, self.year = journal, terms, year


class ArticleReader(DataSourceReader):
    """Each bucket: ids of all its terms, the first term to list an id owning it, fetched in chunks."""

    def __init__(self, options: dict):
        self.root, self.client = options["path"], options.get("client", "litmill.sources.search:LandedClient")
        self.rate = float(options["rate"]) if options.get("rate") else None
        self.journals = json.loads(options["journals"])
        self.years = range(int(options["first_year"]), int(options["last_year"]) + 1)
        self.chunk = int(options.get("chunk", 200))
        self.most = int(options["max_articles"]) if options.get("max_articles") else None

    def partitions(self) -> list[Bucket]:
        return [Bucket(j, terms, y) for j, terms in self.journals.items() for y in self.years]

    def read(self, bucket: Bucket) -> Iterator[tuple]:
        module, _, name = self.client.partition(":")
        client = Patient(getattr(importlib.import_module(module), name)(self.root), self.rate)
        owner: dict[str, str] = {}
        for term in bucket.terms:
            for pmid in search_year(client, term, bucket.year):
                owner.setdefault(pmid, term)
        ids = sorted(owner, key=numeric_first)[: self.most]
        for i in range(0, len(ids), self.chunk):
            part = ids[i : i + self.chunk]
            yield bucket.journal, bucket.year, part, [owner[p] for p in part], client.fetch(part).decode()


class ArticleSource(DataSource):
    """``spark.read.format("articles")`` with options path, journals (JSON of slug to terms), first_year, last_year."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return "journal_slug string, year int, pmids array<string>, terms array<string>, xml string"

    def reader(self, schema) -> ArticleReader:
        return ArticleReader(self.options)
