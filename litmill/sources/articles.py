"""Parsing of landed article XML. Mixed content (inline markup in titles and abstracts) is flattened, which the XML
reader can't do, so articles are parsed in Arrow batches; records that fail go to a table of failures."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.dates import MONTHS
from litmill.schemas import DDL
from litmill.session import expose_package


def _text(node: ET.Element | None) -> str:
    """All text below a node, trimmed."""
    return "".join(node.itertext()).strip() if node is not None else ""


def _month(value: str) -> int | None:
    if value.isdigit():
        return int(value)
    return MONTHS.index(value[:3].lower()) + 1 if value[:3].lower() in MONTHS else None


def _published(article: ET.Element) -> tuple[int | None, str]:
    date = article.find("Journal/JournalIssue/PubDate")
    if date is None:
        return None, ""
    year = _text(date.find("Year"))
    if not year:
        words = "".join(c if c.isalnum() or c == "_" else " " for c in _text(date.find("MedlineDate"))).split()
        return next((int(w) for w in words if len(w) == 4 and w.isdigit()), None), ""
    if not year.lstrip("+-").isdigit():
        return None, ""
    month, day = _month(_text(date.find("Month"))), _text(date.find("Day"))
    if month is None:
        return int(year), ""
    return int(year), f"{int(year):04d}-{month:02d}-{int(day) if day.isdigit() else 1:02d}"


def _authors(article: ET.Element) -> list[dict]:
    out = []
    for a in article.findall("AuthorList/Author"):
        affiliation = _text(a.find("AffiliationInfo/Affiliation"))
        if collective := _text(a.find("CollectiveName")):
            out.append({"last_name": collective, "fore_name": "", "initials": "", "affiliation": affiliation})
        else:
            out.append({"last_name": _text(a.find("LastName")), "fore_name": _text(a.find("ForeName")), "initials": _text(a.find("Initials")), "affiliation": affiliation})
    return out


def _headings(citation: ET.Element) -> list[dict]:
    out = []
    for h in citation.findall("MeshHeadingList/MeshHeading"):
        d = h.find("DescriptorName")
        if d is None:
            continue
        marks = lambda n: {"ui": n.get("UI", ""), "major_topic": n.get("MajorTopicYN", "N") == "Y"}
        out.append({
            "descriptor": _text(d), "descriptor_ui": d.get("UI", ""), "major_topic": marks(d)["major_topic"],
            "qualifiers": [{"name": _text(q)} | marks(q) for q in h.findall("QualifierName")],
        })
    return out


def parse_article(node: ET.Element) -> dict:
    """A row of papers; ValueError if the record lacks its citation or article."""
    citation = node.find("MedlineCitation")
    article = citation.find("Article") if citation is not None else None
    if citation is None or article is None:
        raise ValueError("no citation or article")
    segments = [{"label": s.get("Label", ""), "nlm_category": s.get("NlmCategory", ""), "text": _text(s)} for s in article.findall("Abstract/AbstractText")]
    abstract = " ".join(s["text"] for s in segments if s["text"])
    year, date = _published(article)
    doi = next((_text(e) for e in article.findall("ELocationID") if e.get("EIdType") == "doi" and _text(e)), "")
    return {
        "pmid": _text(citation.find("PMID")), "title": _text(article.find("ArticleTitle")), "abstract": abstract, "abstract_segments": segments,
        "journal": _text(article.find("Journal/Title")), "journal_ta": _text(article.find("Journal/ISOAbbreviation")) or _text(citation.find("MedlineJournalInfo/MedlineTA")),
        "year": year, "pub_date": date, "doi": doi, "publication_types": [t for t in map(_text, article.findall("PublicationTypeList/PublicationType")) if t],
        "authors": _authors(article), "mesh_headings": _headings(citation), "has_abstract": abstract != "",
    }


def parse_set(body: bytes | str) -> tuple[list[dict], list[dict]]:
    """(rows, failures) of an article set."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        return [], [{"raw_xml": "<root>", "error": str(e)}]
    rows, failures = [], []
    for node in root.iter("PubmedArticle"):
        try:
            rows.append(parse_article(node))
        except Exception as e:
            failures.append({"raw_xml": ET.tostring(node, encoding="unicode")[:2000], "error": str(e)})
    return rows, failures


def parse(documents: DataFrame, xml_column: str = "xml", keys: list[str] | None = None) -> DataFrame:
    """Rows (keys ..., failed: boolean, paper: struct of papers, failure: struct) of a table of article sets."""
    expose_package(documents.sparkSession)
    keys = keys or []
    kinds = dict(documents.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + f"failed boolean, paper struct<{_struct(DDL['papers'])}>, failure struct<raw_xml: string, error: string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = dict.fromkeys(["journal_slug", "fetched_at", "source_ta_match"])
        for batch in batches:
            out = []
            for *key, body in batch[[*keys, xml_column]].itertuples(index=False, name=None):
                of = dict(zip(keys, key, strict=True))
                rows, failures = parse_set(body if body is not None else "")
                out += [of | {"failed": False, "paper": blank | r, "failure": None} for r in rows]
                out += [of | {"failed": True, "paper": None, "failure": f} for f in failures]
            yield pd.DataFrame(out, columns=[*keys, "failed", "paper", "failure"])

    return documents.select(*keys, xml_column).mapInPandas(run, schema)


def _struct(ddl: str) -> str:
    """Top-level columns of a table as struct fields."""
    out, depth = [], 0
    for piece in ddl.split(","):
        if depth == 0:
            name, _, kind = piece.strip().partition(" ")
            out.append(f"{name}: {kind}")
        else:
            out[-1] += "," + piece
        depth += piece.count("<") - piece.count(">")
    return ", ".join(out)


def papers(parsed: DataFrame) -> DataFrame:
    return parsed.filter("NOT failed").select("paper.*")


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.filter("failed").select("failure.*")


def search_result(documents: DataFrame, xml_column: str = "xml", keys: list[str] | None = None) -> DataFrame:
    """Rows (keys ..., total, ids) of search responses: a bad count is 0, blank ids go."""
    x = F.col(xml_column)
    ids = F.filter(F.transform(F.xpath(x, F.lit("/eSearchResult/IdList/Id/text()")), lambda i: F.trim(i)), lambda i: i != "")
    return documents.select(*(keys or []), F.coalesce(F.xpath_string(x, F.lit("/eSearchResult/Count")).try_cast("long"), F.lit(0)).alias("total"), ids.alias("ids"))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed XML files as a table (path, xml)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("xml"))
