import json

import pytest
from pyspark.sql import functions as F

from litmill import config
from litmill.schemas import conform, empty, schema
from litmill.sources import articles, search, services, tables

ARTICLE = """<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><Title>Journal of Knees</Title><ISOAbbreviation>J Knee</ISOAbbreviation>
<JournalIssue><PubDate>{date}</PubDate></JournalIssue></Journal><ArticleTitle>On <i>the</i> knee</ArticleTitle><ELocationID EIdType="doi">10.1/{pmid}</ELocationID>
<Abstract><AbstractText Label="METHODS">We <b>cut</b> it.</AbstractText><AbstractText>It healed.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Ann</ForeName><Initials>A</Initials></Author><Author><CollectiveName>Knee Group</CollectiveName></Author></AuthorList>
<PublicationTypeList><PublicationType>Letter</PublicationType><PublicationType> </PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="Y">Knee Joint</DescriptorName><QualifierName UI="Q1" MajorTopicYN="N">surgery</QualifierName></MeshHeading></MeshHeadingList>
</MedlineCitation></PubmedArticle>"""


def article(pmid, date="<Year>2024</Year><Month>Mar</Month><Day>15</Day>"):
    return ARTICLE.format(pmid=pmid, date=date)


def test_articles(spark):
    body = f"<PubmedArticleSet>{article(1)}{article(2, '<MedlineDate>1995-1996</MedlineDate>')}<PubmedArticle><x/></PubmedArticle></PubmedArticleSet>"
    parsed = articles.parse(spark.createDataFrame([(body,), ("<broken",), (None,)], "xml string"))
    rows = {r.pmid: r for r in articles.papers(parsed).collect()}
    assert rows["1"].title == "On the knee" and rows["1"].abstract == "We cut it. It healed." and rows["1"].pub_date == "2024-03-15"
    assert rows["1"].doi == "10.1/1" and rows["1"].publication_types == ["Letter"] and rows["1"].authors[1].last_name == "Knee Group"
    assert rows["1"].mesh_headings[0].descriptor_ui == "D1" and rows["1"].mesh_headings[0].major_topic and rows["1"].mesh_headings[0].qualifiers[0].name == "surgery"
    assert (rows["2"].year, rows["2"].pub_date) == (1995, "")
    assert sorted(r.raw_xml[:6] for r in articles.failures(parsed).collect()) == ["<Pubme", "<root>", "<root>"]
    assert conform(articles.papers(parsed), "papers").schema == schema("papers")


def test_search_result(spark):
    xml = "<eSearchResult><Count>2</Count><IdList><Id>5</Id><Id> </Id><Id>7</Id></IdList></eSearchResult>"
    got = articles.search_result(spark.createDataFrame([(xml,), ("<eSearchResult/>",)], "xml string")).collect()
    assert (got[0].total, got[0].ids) == (2, ["5", "7"]) and (got[1].total, got[1].ids) == (0, [])


WORKS = [
    {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/a", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/11/"}, "publication_year": 2020, "cited_by_count": 3,
     "concepts": [{"id": "https://openalex.org/C1", "display_name": "x", "score": 0.1}, {"id": "https://openalex.org/C2", "display_name": "y", "score": 0.9}],
     "authorships": [{"author_position": "first", "author": {"id": None, "display_name": "Ann Müller", "orcid": None}, "institutions": [], "raw_affiliation_strings": ["Knee Clinic"]},
                     {"author_position": "last", "author": {"id": "https://openalex.org/A2", "display_name": "B", "orcid": "https://orcid.org/0-1"}, "institutions": [{"id": None, "display_name": "Uni X", "ror": "https://ror.org/05", "country_code": "DE", "type": "education"}], "raw_affiliation_strings": []}],
     "referenced_works": ["https://openalex.org/W9", "", "https://openalex.org/W8"]},
    {"id": "https://openalex.org/W2", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/12"}},
]


def works(spark):
    return spark.createDataFrame([(json.dumps(w),) for w in WORKS], "j string").select(F.from_json("j", services.WORK).alias("w")).select("w.*")


def test_works(spark):
    rows = {r.pmid: r for r in services.works(works(spark), "now").collect()}
    assert rows["11"].oa_doi == "10.1/a" and [c.id for c in rows["11"].concepts] == ["C2", "C1"]
    assert (rows["12"].oa_doi, rows["12"].cited_by_count, rows["12"].is_oa, rows["12"].concepts) == ("", 0, False, [])
    assert [(r.ref_openalex_id, r.ref_position) for r in services.references(works(spark)).orderBy("ref_position").collect()] == [("W9", 0), ("W8", 2)]
    staged = services.staging(works(spark)).orderBy("author_position").collect()
    assert staged[0].author_oa_id == "" and staged[1].institutions[0].ror_id == "05" and staged[1].author_orcid == "0-1"


def test_papers_and_intents(spark):
    body = {"paperId": "p", "externalIds": {"DOI": "d"}, "citationCount": 2, "references": [
        {"paperId": "r1", "externalIds": {"PubMed": "99"}, "intents": ["background", ""], "isInfluential": True}, {"paperId": "r2", "externalIds": None, "intents": []}, {"paperId": None, "externalIds": None}]}
    df = spark.createDataFrame([("1", json.dumps(body)), ("2", None)], "pmid string, j string").select("pmid", F.from_json("j", services.PAPER).alias("paper"))
    rows = {r.pmid: r for r in services.papers(df, "now").collect()}
    assert rows["1"].references_with_intent_count == 1 and (rows["2"].ss_id, rows["2"].citation_count, rows["2"].references_with_intent_count) == ("", 0, 0)
    assert {(r.cited_id, tuple(r.intents), r.is_influential) for r in services.intents(df).collect()} == {("PMID:99", ("background",), True), ("SS:r2", (), False)}


def test_affiliations(spark):
    items = "items array<struct<score: double, organization struct<id: string, name: string, country struct<country_code: string>, types array<string>>>>".replace("organization struct", "organization: struct").replace("country struct", "country: struct").replace("types array", "types: array")
    rows = [("a", [(0.97, ("ror1", "Uni", ("DE",), ["education"]))]), ("b", [(0.5, ("ror2", "Uni", ("DE",), []))]), ("c", [])]
    got = {r.raw_string: r for r in services.affiliation_matches(spark.createDataFrame(rows, f"raw_string string, {items}"), "now").collect()}
    assert (got["a"].ror_id, got["a"].type) == ("ror1", "education") and got["b"].ror_id == "" and got["b"].match_score == 0.5 and got["c"].match_score == 0.0


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    tables.write_table(empty(spark, "topics"), root, "topics")
    assert spark.read.parquet(f"{root}/topics.parquet").schema == schema("topics")
    assert tables.read_optional(spark, f"{root}/none.parquet") is None and tables.read_optional(spark, f"{root}/none.parquet", "topics").count() == 0
    with pytest.raises(ValueError):
        schema("nothing")
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "pmid string, status string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "pmid string, status string")
    assert sorted(map(tuple, tables.upsert(old, new, ["pmid"]).collect())) == [("1", "a"), ("2", "c"), ("3", "d")]
    tables.write_manifest(f"{root}/m/a.json", {"pmids": ["1"]})
    assert tables.read_manifest(f"{root}/m/a.json")["pmids"] == ["1"] and tables.read_manifest(f"{root}/m/b.json") is None
    (tmp_path / "blank").write_text(" ")
    assert tables.read_staging(f"{root}/blank") == [] and tables.read_staging(f"{root}/x") is None
    sidecar = json.loads(open(tables.record_run(f"{root}/art", [f"{root}/m", f"{root}/none"], {"a": 1}, spark)).read())
    assert sidecar["inputs"][f"{root}/none"] is None and len(sidecar["config_sha256"]) == 64
    assert not tables.write_failures(empty(spark, "parse_failures"), f"{root}/f")
    papers = conform(spark.createDataFrame([("1", "j", 2000), ("2", "j", 2001)], "pmid string, journal_slug string, year int"), "papers")
    tables.write_buckets(papers, f"{root}/papers")
    tables.write_buckets(papers.filter("year = 2001").withColumn("title", F.lit("new")), f"{root}/papers")
    assert {(r.pmid, r.title) for r in tables.read(spark, f"{root}/papers").collect()} == {("1", None), ("2", "new")}
    assert tables.register_corpus(spark, f"{root}/papers") == ["papers", "journals", "mesh"] and tables.register_corpus(spark, f"{root}/nothing") == []
    assert spark.table("mesh").count() == 0 and "papers" in tables.describe(spark)
    cache = spark.createDataFrame([("12", '{"a": 1}'), ("13", "{bad")], "pmid string, raw_json string")
    tables.write_cache(cache, f"{root}/cache")
    assert {r.pmid: (r.document.a if r.document else None) for r in tables.read_cache(spark, f"{root}/cache", "a int").collect()} == {"12": 1, "13": None}


def test_search_source(spark, tmp_path):
    (tmp_path / "articles").mkdir()
    for i in (1, 2, 3, 4, 5):
        (tmp_path / "articles" / f"{i}.xml").write_text(article(i))
    (tmp_path / "searches.json").write_text(json.dumps({'"A"[TA] AND 2024[DP]': ["3", "4", "5"], '"B"[TA] AND 2024[DP]': ["1", "2", "3"]}))
    spark.dataSource.register(search.ArticleSource)
    df = spark.read.format("articles").option("path", str(tmp_path)).option("journals", json.dumps({"arthro": ["A", "B"]})).option("first_year", 2024).option("last_year", 2024).option("chunk", 2).load()
    from litmill.plans import jobs

    report = jobs.harvest(df, f"{tmp_path}/out")
    assert report == {"buckets": 1, "papers": 5, "failures": 0}
    assert {r.pmid: r.source_ta_match for r in tables.read(spark, f"{tmp_path}/out/papers").collect()} == {"1": "B", "2": "B", "3": "A", "4": "A", "5": "A"}
    assert sorted(["b", "10", "9"], key=search.numeric_first) == ["9", "10", "b"]


def test_limits():
    now = [0.0]
    limiter = search.RateLimiter(2, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(6):
        limiter.acquire()
    assert now[0] == pytest.approx(2.0)
    calls = []
    with pytest.raises(OSError):
        search.retried(lambda: calls.append(1) or (_ for _ in ()).throw(OSError()), 3, 0, lambda s: None)
    assert len(calls) == 3


def test_config():
    text = "a: 1\nb:\n  c: [x, 2]\n  d: 'q'\nlist:\n  - name: j\n    n: 2\n  - name: k\nflag: true # yes\nnone:\n"
    assert config.parse(text) == {"a": 1, "b": {"c": ["x", 2], "d": "q"}, "list": [{"name": "j", "n": 2}, {"name": "k"}], "flag": True, "none": None}
