"""Drivers of the lookup services: batched requests behind an injected client, with rate limit, retries, fallback to single
ids, cached documents, a manifest and a table of failures. Nothing here opens a network connection.

A client is what a picklable factory makes in each task; it has ``lookup(ids) -> {id: JSON text}``, and leaves out ids it
doesn't know. ``LandedDocuments`` serves files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.session import expose_package, written
from litmill.sources import services, tables
from litmill.sources.search import RateLimiter, retried

BATCH = 50
ANSWER = "pmid string, status string, reason string, raw_json string, attempted_at string"


class LandedDocuments:
    """Serves ``<id>.json`` files of a folder."""

    def __init__(self, root: str):
        self.root = Path(root)

    def lookup(self, ids: list[str]) -> dict[str, str]:
        return {i: p.read_text() for i in ids if (p := self.root / f"{i}.json").exists()}


def lookup_batch(client, ids: list[str], size: int = BATCH, limiter: RateLimiter | None = None, attempts: int = 5, sleep: Callable | None = None) -> dict[str, str]:
    """The documents of at most ``size`` ids; ValueError above that. An empty list asks nothing."""
    if len(ids) > size:
        raise ValueError(f"{len(ids)} ids in a batch of at most {size}")
    if not ids:
        return {}

    def ask() -> dict[str, str]:
        if limiter is not None:
            limiter.acquire()
        return client.lookup(ids)

    return retried(ask, attempts, **({"sleep": sleep} if sleep else {}))


def answers(client, ids: list[str], size: int = BATCH, limiter: RateLimiter | None = None, attempts: int = 5, sleep: Callable | None = None) -> Iterator[tuple[str, str, str, str | None]]:
    """(id, status, reason, JSON) of every id. A batch that fails is asked for id by id; an id without document is a
    miss; a document that isn't a JSON object is an error."""
    how = {"size": size, "limiter": limiter, "attempts": attempts, "sleep": sleep}
    for i in range(0, len(ids), size):
        part, failed = ids[i : i + size], {}
        try:
            found = lookup_batch(client, part, **how)
        except OSError:
            found = {}
            for one in part:
                try:
                    found |= lookup_batch(client, [one], **how)
                except OSError as e:
                    failed[one] = f"{type(e).__name__}: {e}"[:200]
        for one in part:
            body = found.get(one)
            if one in failed:
                yield one, "error", failed[one], None
            elif body is None:
                yield one, "missing", "not found", None
            else:
                try:
                    good = isinstance(json.loads(body), dict)
                except ValueError:
                    good = False
                yield (one, "ok", "", body) if good else (one, "error", "not a JSON object", body)


def fetch(ids: DataFrame, make_client: Callable, size: int = BATCH, rate: float | None = None, attempts: int = 5, at: str | None = None) -> DataFrame:
    """Rows of ``ANSWER`` of the ids (pmid). ``rate`` is that of a task; as many tasks as ``ids`` has partitions ask at once."""
    expose_package(ids.sparkSession)
    now = at or datetime.now(UTC).isoformat(timespec="seconds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, limiter = make_client(), RateLimiter(rate) if rate else None
        for batch in batches:
            rows = [(*row, now) for row in answers(client, list(batch["pmid"]), size, limiter, attempts)]
            yield pd.DataFrame(rows, columns=["pmid", "status", "reason", "raw_json", "attempted_at"])

    return ids.select("pmid").mapInPandas(run, ANSWER)


def drive(spark: SparkSession, root: str, source: str, ids: DataFrame, make_client: Callable | None, key: str | None = None, needs_key: bool = False, **how) -> dict[str, int]:
    """Brings a source's cache, manifest and failures below ``root`` up to date for ``ids`` (pmid) and reports counts.

    Ids that the manifest has as fetched are not asked for again. Without the key that a source needs, or without a
    client, nothing is asked and the tables stay as they are or come out empty, in their schemas."""
    at, cache, failures = f"{root}/{source}_manifest.parquet", f"{root}/{source}_cache.parquet", f"{root}/{source}_failed.parquet"
    manifest = tables.read_optional(spark, at, "manifest")
    todo = ids.filter("pmid IS NOT NULL AND pmid <> ''").select("pmid").distinct().join(manifest.filter("status = 'ok'").select("pmid"), "pmid", "left_anti")
    asked = make_client is not None and not (needs_key and not key)
    got = written(fetch(todo, make_client, **how), "answers") if asked else spark.createDataFrame([], ANSWER)
    good = got.filter("status = 'ok'")
    marks = got.select("pmid", F.col("attempted_at").alias("fetched_at"), "status", F.get_json_object("raw_json", "$.id").alias("openalex_id"))
    tables.flush_cache(spark, at, tables.conform(marks, "manifest"), ["pmid"])
    tables.flush_cache(spark, cache, good.select("pmid", "raw_json"), ["pmid"])
    old = tables.read_optional(spark, failures, "enrichment_failed")
    bad = got.filter("status <> 'ok'").select("pmid", F.lit(source).alias("source"), "reason", "attempted_at")
    tables.replace_table(tables.upsert(old.join(good.select("pmid"), "pmid", "left_anti"), bad, ["pmid"]), failures)
    counts = {r.status: r.n for r in got.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"asked": sum(counts.values()), "ok": counts.get("ok", 0), "failed": sum(counts.values()) - counts.get("ok", 0)}


def documents(spark: SparkSession, root: str, source: str, schema: str) -> DataFrame:
    """Rows (pmid, document) of a source's cache; a document that doesn't fit the schema is null."""
    return tables.read_cache(spark, f"{root}/{source}_cache.parquet", schema).select("pmid", "document")


ITEMS = "array<struct<organization: struct<id: string, name: string, country: struct<country_code: string>, types: array<string>>, score: double>>"


def affiliations(spark: SparkSession, path: str, raw: DataFrame, make_client: Callable, gate: float = 0.85, rate: float | None = None, attempts: int = 5, at: str | None = None) -> DataFrame:
    """The cache of affiliation lookups (at ``path``) with all of ``raw`` (raw_string): what it holds, hits and misses
    alike, isn't asked for again. A client has ``match(text) -> JSON text`` with ``items``, the best first; an item counts
    if its score passes the gate. A text whose request fails is left out and asked for the next time."""
    expose_package(spark)
    now = at or datetime.now(UTC).isoformat(timespec="seconds")
    known = tables.affiliation_cache(spark, path)
    wanted = raw.select(F.trim("raw_string").alias("raw_string")).filter("raw_string <> ''").distinct().join(known.select("raw_string"), "raw_string", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, limiter = make_client(), RateLimiter(rate) if rate else None

        def ask(text: str) -> str:
            if limiter is not None:
                limiter.acquire()
            return client.match(text)

        for batch in batches:
            out = []
            for text in batch["raw_string"]:
                try:
                    out.append((text, retried(lambda text=text: ask(text), attempts)))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["raw_string", "body"])

    answered = written(wanted.mapInPandas(run, "raw_string string, body string"), "affiliations")
    items = answered.select("raw_string", F.from_json("body", f"items {ITEMS}").getField("items").alias("items"))
    tables.flush_cache(spark, path, tables.conform(services.affiliation_matches(items, now, gate), "affiliation_cache"), ["raw_string"])
    return tables.affiliation_cache(spark, path)
