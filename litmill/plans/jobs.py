"""The jobs: harvest, enrich, embed, topics, sample and pilot, from tables to tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.text import has_text, prompt, title_and_abstract
from litmill.operators import dedup, labels, resolve, topics, vectors
from litmill.schemas import ENRICHMENT, conform, empty
from litmill.session import written
from litmill.sources import articles, drivers, services, tables


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def harvest(fetched: DataFrame, root: str, known: DataFrame | None = None, fetched_at: str | None = None) -> dict:
    """Parses fetched article sets (journal_slug, year, pmids, terms, xml), writes the buckets that changed and the
    failures, and reports counts."""
    at = fetched_at or now()
    ids = fetched.select("journal_slug", "year", F.explode("pmids").alias("pmid"))
    digests = tables.bucket_digest(ids, ["journal_slug", "year"])
    if known is not None:
        fetched = fetched.join(tables.changed_buckets(digests, known, ["journal_slug", "year"]).select("journal_slug", "year"), ["journal_slug", "year"], "left_semi")
    bucket = ["journal_slug", "year"]
    listed = fetched.select(*[F.col(c).alias(f"of_{c}") for c in bucket], F.explode(F.arrays_zip("pmids", "terms")).alias("x"))
    owners = listed.select("of_journal_slug", "of_year", F.col("x.pmids").alias("pmid"), F.col("x.terms").alias("term")).distinct()
    sets = fetched.select(*[F.col(c).alias(f"of_{c}") for c in bucket], "xml")
    parsed = written(articles.parse(sets, keys=["of_journal_slug", "of_year"]), "parsed")
    rows = parsed.filter("NOT failed").select("of_journal_slug", "of_year", "paper.*").drop("journal_slug", "fetched_at", "source_ta_match")
    rows = rows.join(owners, ["of_journal_slug", "of_year", "pmid"], "left")
    rows = rows.withColumn("journal_slug", F.col("of_journal_slug")).withColumn("source_ta_match", F.col("term")).withColumn("fetched_at", F.lit(at))
    failed = articles.failures(parsed)
    tables.write_buckets(conform(rows, "papers"), f"{root}/papers")
    tables.write_failures(failed, f"{root}/failures")
    counted = parsed.agg(F.count_if(~F.col("failed")).alias("papers"), F.count_if("failed").alias("failures")).first()
    return {"buckets": fetched.select(*bucket).distinct().count(), "papers": counted.papers, "failures": counted.failures}


def demo(spark: SparkSession, path: str, root: str, journal: str, first_year: int, last_year: int, most: int = 100) -> dict:
    """Harvests up to ``most`` papers of one journal from landed files into a small corpus."""
    import json

    from litmill.sources.search import ArticleSource

    spark.dataSource.register(ArticleSource)
    options = {"path": path, "journals": json.dumps({journal: [journal]}), "first_year": first_year, "last_year": last_year, "max_articles": most}
    return harvest(spark.read.format("articles").options(**options).load(), root)


def ids_to_enrich(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """Different non-empty ids in text order, cut after sorting."""
    ids = papers.filter("pmid IS NOT NULL AND pmid <> ''").select("pmid").distinct().orderBy("pmid")
    return ids.limit(limit) if limit is not None else ids


def to_fetch(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """Ids without a fetched document: missing and failed ones are asked for again."""
    return ids.join(manifest.filter("status = 'ok'").select("pmid"), "pmid", "left_anti")


def enrich_from_services(spark: SparkSession, root: str, ids: DataFrame, clients: dict[str, Callable], keys: dict[str, str] | None = None, merge: bool = True, **how) -> dict[str, int]:
    """Fetches what is missing of the sources ``works`` and ``papers``, side by side, and writes the enrichment tables
    from all documents held. ``papers`` needs a key; without it its tables keep their schemas only."""
    keys = keys or {}

    def fetched(source: str) -> dict[str, int]:
        return drivers.drive(spark, root, source, ids, clients.get(source), keys.get(source), source == "papers", **how)

    with ThreadPoolExecutor(2) as pool:
        counts = dict(zip(("works", "papers"), pool.map(fetched, ("works", "papers")), strict=True))
    works = drivers.documents(spark, root, "works", services.WORK).filter("document IS NOT NULL").select("document.*")
    papers = drivers.documents(spark, root, "papers", services.PAPER).select("pmid", F.col("document").alias("paper"))
    failed = [tables.read_optional(spark, f"{root}/{s}_failed.parquet", "enrichment_failed") for s in ("works", "papers")]
    written_rows = enrich(spark, root, works, papers, merge=merge, failed=failed[0].unionByName(failed[1]))
    return written_rows | {f"{source}_{what}": n for source, row in counts.items() for what, n in row.items()}


def enrich(
    spark: SparkSession, root: str, works: DataFrame | None = None, answers: DataFrame | None = None, cache: DataFrame | None = None,
    only: set[str] | None = None, skip: set[str] = frozenset(), merge: bool = False, failed: DataFrame | None = None,
) -> dict[str, int]:
    """Writes the enrichment tables from landed works and answers; sources that are left out give empty tables.
    ``merge`` keeps rows of other papers."""
    chosen = {s for s in ("works", "authors", "affiliations", "papers") if (only is None or s in only) and s not in skip}
    unknown = ((only or set()) | set(skip)) - {"works", "authors", "affiliations", "papers"}
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}")
    at, out = now(), {name: empty(spark, name) for name in ENRICHMENT}
    if works is not None and "works" in chosen:
        out["openalex_works"], out["references_out"] = services.works(works, at), services.references(works)
        staging = services.staging(works)
        if "authors" in chosen:
            out["authorships"] = resolve.authors(staging)
        if "affiliations" in chosen:
            out["institutions"], out["paper_institutions"] = resolve.institutions(staging, cache if cache is not None else empty(spark, "affiliation_cache"))
    if answers is not None and "papers" in chosen:
        out["semantic_scholar"], out["citation_intents"] = services.papers(answers, at), services.intents(answers)
    keys = {"openalex_works": ["pmid"], "references_out": ["citing_pmid"], "authorships": ["pmid"], "institutions": ["institution_canonical_id"], "paper_institutions": ["pmid"], "semantic_scholar": ["pmid"], "citation_intents": ["citing_pmid"], "enrichment_failed": ["pmid"]}
    if failed is not None:
        out["enrichment_failed"] = failed
    counts = {}
    for name, df in out.items():
        df = conform(df, name)
        if merge and (old := tables.read_optional(spark, f"{root}/{name}.parquet")) is not None:
            df = conform(tables.upsert(old, df, keys[name]), name)
        tables.replace_table(df, f"{root}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{root}/{name}.parquet").count()
    return counts


def embed(papers: DataFrame, model: str = "mpnet", limit: int | None = None, distinct: bool = True) -> DataFrame:
    """Rows of embeddings of papers with an abstract, by numeric id; of different papers unless asked otherwise."""
    rows = dedup.distinct_papers(papers) if distinct else papers
    rows = rows.filter(has_text(F.col("abstract"))).select(F.col("pmid").cast("long").alias("pmid"), title_and_abstract(F.col("title"), F.col("abstract")).alias("text"))
    rows = rows.orderBy("pmid").limit(limit) if limit is not None else rows
    return vectors.embed(rows, model)


def topic_model(embeddings: DataFrame, papers: DataFrame, configs: list[topics.TopicConfig], selector: str = "npmi_top10") -> dict[str, DataFrame]:
    """Sweep, choice, assignment and hierarchy."""
    import json

    docs = papers.select(F.col("pmid").cast("long").alias("pmid"), title_and_abstract(F.col("title"), F.col("abstract")).alias("text"))
    dedup.require_known(embeddings, docs)
    swept = topics.sweep(embeddings, docs, configs)
    best = topics.choose(swept, selector).collect()
    if not best:
        raise ValueError("every configuration failed")
    config = topics.TopicConfig(**json.loads(best[0].config))
    assigned = written(topics.fit(embeddings, config), "assigned")
    if (n := assigned.count()) != (m := embeddings.count()):
        raise ValueError(f"{n} rows assigned for {m} embeddings")
    words = topics.word_lists(topics.top_words(topics.class_weights(docs.join(assigned.filter("NOT is_noise"), "pmid"), ngram=config.ngram, min_df=config.min_df), n=config.top_n))
    return {"sweep": swept, "topics": assigned, "hierarchy": topics.hierarchy(assigned, embeddings, words, config)}


def pilot(sample: DataFrame, head: str, n: int = 50, **how) -> tuple[DataFrame, DataFrame]:
    """Labels by a model of the first ``n`` sampled papers, and failures."""
    return labels.pilot(sample.select("pmid", prompt(head, F.col("abstract")).alias("prompt")), n, **how)
