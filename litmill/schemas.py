"""Declared schemas of the persisted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME_UI = "name: string, ui: string, major_topic: boolean"
DDL = {
    "papers": (
        "pmid string, journal_slug string, title string, abstract string, abstract_segments array<struct<label: string, nlm_category: string, text: string>>, "
        "journal string, journal_ta string, year int, pub_date string, doi string, publication_types array<string>, "
        "authors array<struct<last_name: string, fore_name: string, initials: string, affiliation: string>>, "
        f"mesh_headings array<struct<descriptor: string, descriptor_ui: string, major_topic: boolean, qualifiers: array<struct<{_NAME_UI}>>>>, "
        "has_abstract boolean, fetched_at string, source_ta_match string"
    ),
    "openalex_works": (
        "pmid string, openalex_id string, oa_doi string, type string, language string, is_retracted boolean, is_oa boolean, oa_status string, "
        "cited_by_count long, concepts array<struct<id: string, display_name: string, score: double>>, publication_year int, publication_date string, fetched_at string"
    ),
    "references_out": "citing_pmid string, ref_openalex_id string, ref_pmid_if_known string, ref_year int, ref_position int",
    "authorships": (
        "pmid string, author_position int, author_position_label string, author_oa_id string, author_orcid string, author_display_name string, "
        "author_canonical_id string, disambiguation_method string, is_first boolean, is_last boolean"
    ),
    "institutions": "institution_canonical_id string, institution_oa_id string, ror_id string, display_name string, country_code string, type string",
    "paper_institutions": "pmid string, author_position int, institution_canonical_id string, raw_affiliation_string string, ror_matched_by string",
    "semantic_scholar": "pmid string, ss_id string, ss_doi string, citation_count long, references_with_intent_count long, fetched_at string",
    "citation_intents": "citing_pmid string, cited_id string, intents array<string>, is_influential boolean",
    "enrichment_failed": "pmid string, source string, reason string, attempted_at string",
    "staging": (
        "pmid string, author_position int, author_position_label string, author_oa_id string, author_orcid string, author_display_name string, "
        "institutions array<struct<oa_id: string, ror_id: string, display_name: string, country_code: string, type: string>>, raw_affiliation_strings array<string>"
    ),
    "manifest": "pmid string, fetched_at string, status string, openalex_id string",
    "affiliation_cache": "raw_string string, ror_id string, ror_display_name string, country_code string, type string, match_score double, fetched_at string",
    "embeddings": "pmid long, embedding array<float>, model_name string",
    "vector_rows": "row_id int, pmid long",
    "topics": "pmid long, topic_id long, is_noise boolean",
    "topic_hierarchy": "topic_id long, top_words array<string>, size long, mid_level_id long, top_level_id long, representative_docs array<long>",
    "topic_sweep": "config string, n_leaf_topics long, noise_fraction double, npmi_top10 double, cv_top10 double, wall_seconds double, error string",
    "handlabel_sample": "pmid long, journal string, year int, era string, topic_id long, title string, abstract string",
    "epistemic_handlabel": "pmid long, rater string, field string, value string, imported_at string",
    "epistemic_pilot": (
        "pmid long, study_design string, sample_size long, has_control boolean, statistical_claim_present boolean, effect_direction string, "
        "coi_disclosed_in_abstract boolean, model_id string, prompt_version string, raw_response string, extracted_at string"
    ),
    "epistemic_pilot_failed": "pmid long, reason string, raw_response string, model_id string, prompt_version string, failed_at string",
    "parse_failures": "raw_xml string, error string",
}
ENRICHMENT = ("openalex_works", "references_out", "authorships", "institutions", "paper_institutions", "semantic_scholar", "citation_intents", "enrichment_failed")


def schema(name: str) -> T.StructType:
    if name not in DDL:
        raise ValueError(f"unknown table {name!r}; known are {', '.join(sorted(DDL))}")
    return T.StructType.fromDDL(DDL[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of the declared schema, in order: missing ones as null, further ones dropped."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])
