"""Landed JSON of the bibliographic services, parsed by column expressions into the enrichment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.arrays import top_by_score
from litmill.functions.text import strip_prefix, trim_slashes

#: The prefixes of the services' identifiers.
WORK_PREFIX, DOI_PREFIX, PMID_PREFIX = "https://openalex.org/", "https://doi.org/", "https://pubmed.ncbi.nlm.nih.gov/"
ORCID_PREFIX, ROR_PREFIX = "https://orcid.org/", "https://ror.org/"
WORK = (
    "id string, doi string, ids struct<openalex: string, doi: string, pmid: string>, publication_year int, publication_date string, type string, language string, "
    "is_retracted boolean, open_access struct<is_oa: boolean, oa_status: string>, cited_by_count long, concepts array<struct<id: string, display_name: string, score: double>>, "
    "authorships array<struct<author_position: string, author: struct<id: string, display_name: string, orcid: string>, "
    "institutions: array<struct<id: string, display_name: string, ror: string, country_code: string, type: string>>, raw_affiliation_strings: array<string>>>, referenced_works array<string>"
)
PAPER = (
    "paperId string, externalIds struct<DOI: string, PubMed: string>, citationCount long, "
    "references array<struct<paperId: string, externalIds: struct<PubMed: string>, intents: array<string>, isInfluential: boolean>>"
)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def work_pmid(work: DataFrame) -> Column:
    return trim_slashes(strip_prefix(F.col("ids.pmid"), PMID_PREFIX))


def works(batch: DataFrame, fetched_at: str) -> DataFrame:
    """Rows of openalex_works of works (schema ``WORK``); missing scalars become empty, 0 or false."""
    concepts = F.transform(top_by_score(F.coalesce("concepts", F.array().cast("array<struct<id:string,display_name:string,score:double>>"))), lambda c: F.struct(
        strip_prefix(c.id, WORK_PREFIX).alias("id"), _text(c.display_name).alias("display_name"), F.coalesce(c.score, F.lit(0.0)).alias("score")))
    return batch.select(
        work_pmid(batch).alias("pmid"), strip_prefix(F.col("id"), WORK_PREFIX).alias("openalex_id"), strip_prefix(F.col("doi"), DOI_PREFIX).alias("oa_doi"),
        _text(F.col("type")).alias("type"), _text(F.col("language")).alias("language"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"), _text(F.col("open_access.oa_status")).alias("oa_status"),
        F.coalesce("cited_by_count", F.lit(0)).cast("long").alias("cited_by_count"), concepts.alias("concepts"),
        F.coalesce("publication_year", F.lit(0)).alias("publication_year"), _text(F.col("publication_date")).alias("publication_date"), F.lit(fetched_at).alias("fetched_at"),
    )


def references(batch: DataFrame) -> DataFrame:
    """Rows of references_out; blank references go, positions stay those of the source."""
    rows = batch.select(work_pmid(batch).alias("citing_pmid"), F.posexplode("referenced_works").alias("ref_position", "ref"))
    rows = rows.withColumn("ref_openalex_id", strip_prefix(F.col("ref"), WORK_PREFIX)).filter("ref_openalex_id <> ''")
    return rows.select("citing_pmid", "ref_openalex_id", F.lit("").alias("ref_pmid_if_known"), F.lit(0).alias("ref_year"), "ref_position")


def staging(batch: DataFrame) -> DataFrame:
    """Rows of the authorship staging table."""
    rows = batch.select(work_pmid(batch).alias("pmid"), F.posexplode("authorships").alias("author_position", "a"))
    institutions = F.transform(F.coalesce("a.institutions", F.array().cast("array<struct<id:string,display_name:string,ror:string,country_code:string,type:string>>")), lambda i: F.struct(
        strip_prefix(i.id, WORK_PREFIX).alias("oa_id"), strip_prefix(i.ror, ROR_PREFIX).alias("ror_id"), _text(i.display_name).alias("display_name"),
        _text(i.country_code).alias("country_code"), _text(i.type).alias("type")))
    return rows.select(
        "pmid", "author_position", _text(F.col("a.author_position")).alias("author_position_label"), strip_prefix(F.col("a.author.id"), WORK_PREFIX).alias("author_oa_id"),
        strip_prefix(F.col("a.author.orcid"), ORCID_PREFIX).alias("author_orcid"), _text(F.col("a.author.display_name")).alias("author_display_name"),
        institutions.alias("institutions"), F.coalesce("a.raw_affiliation_strings", F.array().cast("array<string>")).alias("raw_affiliation_strings"),
    )


def aligned(requests: DataFrame, response: DataFrame, id_column: str = "pmid") -> DataFrame:
    """Requests (position, id) with the papers of a positional response (position, paper); missing ones are null."""
    return requests.join(response, "position", "left").select(F.col(id_column).alias("pmid"), "paper")


def papers(batch: DataFrame, fetched_at: str) -> DataFrame:
    """Rows of semantic_scholar of (pmid, paper: schema ``PAPER``); a null paper gives a row of zeros."""
    emitted = F.filter(F.coalesce("paper.references", F.array().cast("array<struct<paperId:string,externalIds:struct<PubMed:string>,intents:array<string>,isInfluential:boolean>>")), lambda r: cited_id(r) != "")
    with_intents = F.size(F.filter(emitted, lambda r: F.size(F.filter(F.coalesce(r.intents, F.array().cast("array<string>")), lambda i: i != "")) > 0))
    return batch.select(
        "pmid", _text(F.col("paper.paperId")).alias("ss_id"), _text(F.col("paper.externalIds.DOI")).alias("ss_doi"),
        F.coalesce("paper.citationCount", F.lit(0)).cast("long").alias("citation_count"), with_intents.cast("long").alias("references_with_intent_count"), F.lit(fetched_at).alias("fetched_at"),
    )


def cited_id(reference: Column) -> Column:
    """PMID, else the service's own id, else empty."""
    pubmed, own = _text(reference["externalIds"]["PubMed"]), _text(reference["paperId"])
    return F.when(pubmed != "", F.concat(F.lit("PMID:"), pubmed)).when(own != "", F.concat(F.lit("SS:"), own)).otherwise("")


def intents(batch: DataFrame) -> DataFrame:
    """Rows of citation_intents; references without any id are skipped."""
    rows = batch.select("pmid", F.explode("paper.references").alias("r")).withColumn("cited_id", cited_id(F.col("r"))).filter("cited_id <> ''")
    kept = F.filter(F.coalesce("r.intents", F.array().cast("array<string>")), lambda i: i != "")
    return rows.select(F.col("pmid").alias("citing_pmid"), "cited_id", kept.alias("intents"), F.coalesce("r.isInfluential", F.lit(False)).alias("is_influential"))


def affiliation_matches(response: DataFrame, fetched_at: str, gate: float = 0.85) -> DataFrame:
    """Rows of the affiliation cache of (raw_string, items): the first item, its id kept if its score passes the gate."""
    top = F.try_element_at("items", F.lit(1))
    ok = F.coalesce(top["score"] >= gate, F.lit(False))
    organization = top["organization"]
    pick = lambda c: F.when(ok, F.coalesce(c, F.lit(""))).otherwise("")
    return response.select(
        "raw_string", pick(organization["id"]).alias("ror_id"), pick(organization["name"]).alias("ror_display_name"), pick(organization["country"]["country_code"]).alias("country_code"),
        pick(F.try_element_at(organization["types"], F.lit(1))).alias("type"), F.coalesce(top["score"], F.lit(0.0)).alias("match_score"), F.lit(fetched_at).alias("fetched_at"),
    )
