"""Registered queries of enrichment, parsing and labelling: service JSON, articles, authors, topics and label sheets.

The services' documents are built from the test tables, in Spark as structs or XML and in SQL as the rows expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import arrays, dates, text
from litmill.operators import agreement, dedup, labels, reports, resolve, topics, vectors
from litmill.plans import jobs
from litmill.plans.register import query, t
from litmill.sources import articles, services, tables

STAMP = "2026-01-01T00:00:00+00:00"


# Works of the first service


def _works(spark, d) -> DataFrame:
    """Orders as works in the service's form, with nulls where documents lack a part."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    without = lambda every, value: F.when(k % every != 0, value)
    concept = lambda i: F.struct(name(services.WORK_PREFIX + "C", i).alias("id"), name("c", i).alias("display_name"), (((k + i * 3) % 7) / 10.0).alias("score"))
    institution = F.struct(
        F.when(c % 5 != 0, name(services.WORK_PREFIX + "I", c % 20)).alias("id"), name("Inst ", c % 20).alias("display_name"),
        F.when(c % 2 == 0, name(services.ROR_PREFIX + "r", c % 20)).alias("ror"), F.lit("US").alias("country_code"), F.lit("education").alias("type"),
    )

    def author(i: int) -> Column:
        who = c + i
        return F.struct(
            F.lit(("first", "last")[i]).alias("author_position"),
            F.struct(
                F.when(who % 3 != 0, name(services.WORK_PREFIX + "A", c % 50 + i)).alias("id"), name("Jane Doe", F.lit("")).alias("display_name"),
                F.when(who % 4 == 0, name(services.ORCID_PREFIX + "0000-", who)).alias("orcid"),
            ).alias("author"),
            F.array(institution).alias("institutions"), F.array(name("Dept ", c % 10)).alias("raw_affiliation_strings"),
        )

    references = F.array(name(services.WORK_PREFIX + "W", k + 1), F.lit(""), name(services.WORK_PREFIX + "W", k * 2), F.lit(None).cast("string"))
    return t(spark, d, "orders").select(
        name(services.WORK_PREFIX + "W", k).alias("id"), without(3, name(services.DOI_PREFIX + "10.1/", k)).alias("doi"),
        F.struct(F.lit(None).cast("string").alias("openalex"), F.lit(None).cast("string").alias("doi"), F.when(k % 2 == 0, F.concat(name(services.PMID_PREFIX, k), F.lit("/"))).otherwise(k.cast("string")).alias("pmid")).alias("ids"),
        without(4, F.year("o_orderdate")).alias("publication_year"), without(4, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publication_date"),
        F.when(F.col("o_orderstatus") != "F", "article").alias("type"), without(5, F.lit("en")).alias("language"), without(7, k % 7 == 1).alias("is_retracted"),
        without(6, F.struct((k % 2 == 0).alias("is_oa"), F.col("o_orderpriority").alias("oa_status"))).alias("open_access"), without(8, k % 100).alias("cited_by_count"),
        without(9, F.transform(F.sequence(F.lit(0), F.lit(6)), concept)).alias("concepts"), F.array(author(0), author(1)).alias("authorships"), references.alias("referenced_works"),
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS pmid, 'W' || o_orderkey AS openalex_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '10.1/' || o_orderkey END AS oa_doi,
CASE WHEN o_orderstatus <> 'F' THEN 'article' ELSE '' END AS type, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'en' END AS language, o_orderkey % 7 = 1 AS is_retracted,
o_orderkey % 6 <> 0 AND o_orderkey % 2 = 0 AS is_oa, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS oa_status, CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey % 100 END AS cited_by_count,
CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE array_to_string(list_transform(list_sort(list_transform(range(0, 7), lambda i: {'s': -((o_orderkey + i * 3) % 7), 'i': i}))[1:5], lambda x: 'C' || x.i), ',') END AS concepts,
CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(year(o_orderdate) AS INTEGER) END AS publication_year, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS publication_date FROM orders""")
def q_enrich_works(spark, d):
    rows = services.works(_works(spark, d), STAMP).drop("fetched_at")
    return rows.withColumn("concepts", F.array_join(F.transform("concepts", lambda c: c.id), ","))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS citing_pmid, 'W' || (o_orderkey + 1) AS ref_openalex_id, '' AS ref_pmid_if_known, 0 AS ref_year, 0 AS ref_position FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'W' || (o_orderkey * 2), '', 0, 2 FROM orders""")
def q_enrich_references(spark, d):
    return services.references(_works(spark, d))


_STAGING = """SELECT CAST(o_orderkey AS VARCHAR) AS pmid, CAST(i AS INTEGER) AS author_position, CASE i WHEN 0 THEN 'first' ELSE 'last' END AS author_position_label,
CASE WHEN (o_custkey + i) % 3 = 0 THEN '' ELSE 'A' || (o_custkey % 50 + i) END AS author_oa_id, CASE WHEN (o_custkey + i) % 4 = 0 THEN '0000-' || (o_custkey + i) ELSE '' END AS author_orcid,
CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'I' || (o_custkey % 20) END AS inst, CASE WHEN o_custkey % 2 = 0 THEN 'r' || (o_custkey % 20) ELSE '' END AS ror, 'Dept ' || (o_custkey % 10) AS raw
FROM orders, range(0, 2) AS r(i)"""


@query(f"SELECT pmid, author_position, author_position_label, author_oa_id, author_orcid, inst, ror, raw FROM ({_STAGING})")
def q_enrich_staging(spark, d):
    s = services.staging(_works(spark, d))
    first = F.get("institutions", 0)
    return s.select("pmid", "author_position", "author_position_label", "author_oa_id", "author_orcid", first.oa_id.alias("inst"), first.ror_id.alias("ror"), arrays.first_or(F.col("raw_affiliation_strings")).alias("raw"))


@query(f"""WITH s AS ({_STAGING}), u AS (SELECT * FROM s WHERE author_oa_id = '' AND author_orcid = ''), i AS (SELECT inst AS v, count(*) AS n, min((pmid, author_position)) AS seen FROM u WHERE inst <> '' GROUP BY 1),
g AS (SELECT v FROM i ORDER BY n DESC, seen, v LIMIT 1)
SELECT pmid, author_position, CASE WHEN author_orcid <> '' THEN 'ORCID:' || author_orcid WHEN author_oa_id <> '' THEN 'OA:' || author_oa_id ELSE 'H:H' || substr(sha1('authors_v1|doe|j|' || (SELECT v FROM g)), 1, 16) END AS author_canonical_id,
CASE WHEN author_orcid <> '' THEN 'orcid' WHEN author_oa_id <> '' THEN 'openalex' ELSE 'heuristic' END AS disambiguation_method, author_position = 0 AS is_first, author_position = 1 AS is_last FROM s""")
def q_enrich_authors(spark, d):
    rows = resolve.authors(services.staging(_works(spark, d)))
    return rows.select("pmid", "author_position", "author_canonical_id", "disambiguation_method", "is_first", "is_last")


@query(f"""WITH s AS ({_STAGING}) SELECT CASE WHEN inst <> '' THEN 'OA:' || inst WHEN ror <> '' THEN 'ROR:' || ror ELSE 'RAW:' || substr(sha1('inst ' || (CAST(pmid AS BIGINT) * 0 + k)), 1, 16) END AS institution_canonical_id,
count(*) AS n_links, count(DISTINCT pmid) AS n_papers FROM (SELECT s.*, o_custkey % 20 AS k FROM s JOIN orders ON pmid = CAST(o_orderkey AS VARCHAR)) GROUP BY 1""")
def q_enrich_institutions(spark, d):
    table, links = resolve.institutions(services.staging(_works(spark, d)), t(spark, d, "orders").limit(0).selectExpr("'' AS raw_string", "'' AS ror_id", "'' AS ror_display_name", "'' AS country_code", "'' AS type", "0D AS match_score", "'' AS fetched_at"))
    counted = links.groupBy("institution_canonical_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("pmid").alias("n_papers"))
    return table.select("institution_canonical_id").join(counted, "institution_canonical_id")


@query(f"WITH s AS ({_STAGING}) SELECT author_oa_id, count(*) AS n FROM s WHERE length(author_oa_id) > 0 AND author_oa_id IN ('A1', 'A2', 'A3') GROUP BY 1")
def q_authors_by_id_list(spark, d):
    known = t(spark, d, "region").select(F.concat(F.lit("A"), (F.col("r_regionkey") + 1).cast("string")).alias("author_oa_id")).filter(F.col("author_oa_id") < "A4")
    return reports.count_by(services.staging(_works(spark, d)).join(known, "author_oa_id", "left_semi"), "author_oa_id")


# Papers of the second service, in positional batches


def _answers(spark, d) -> DataFrame:
    """Parts as a positional response; every fifth is missing."""
    k = F.col("p_partkey")
    reference = lambda i: F.struct(
        F.when(i != 1, F.concat(F.lit("s"), (k + i).cast("string"))).alias("paperId"), F.struct(F.when((k + i) % 2 == 0, (k + i).cast("string")).alias("PubMed")).alias("externalIds"),
        F.array(F.lit("background"), F.lit(""), F.when(i == 2, "method")).alias("intents"), F.when(i != 2, i == 0).alias("isInfluential"),
    )
    paper = F.struct(
        F.concat(F.lit("p"), k.cast("string")).alias("paperId"), F.struct(F.lit(None).cast("string").alias("DOI"), k.cast("string").alias("PubMed")).alias("externalIds"),
        F.when(k % 3 != 0, k % 50).alias("citationCount"), F.when(k % 4 != 0, F.array(*[reference(F.lit(i)) for i in range(3)])).alias("references"),
    )
    parts = t(spark, d, "part")
    requests = parts.select(k.alias("position"), k.cast("string").alias("pmid"))
    return services.aligned(requests, parts.filter(k % 5 != 0).select(k.alias("position"), paper.alias("paper")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pmid, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'p' || p_partkey END AS ss_id, '' AS ss_doi, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 50 END AS citation_count,
CASE WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 0 THEN 0 ELSE 2 + CASE WHEN (p_partkey + 1) % 2 = 0 THEN 1 ELSE 0 END END::BIGINT AS references_with_intent_count FROM part""")
def q_positional_papers(spark, d):
    return services.papers(_answers(spark, d), STAMP).drop("fetched_at")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS citing_pmid, CASE WHEN (p_partkey + i) % 2 = 0 THEN 'PMID:' || (p_partkey + i) ELSE 'SS:s' || (p_partkey + i) END AS cited_id, CASE WHEN i = 2 THEN 'background,method' ELSE 'background' END AS intents, i = 0 AS is_influential
FROM part, range(0, 3) AS r(i) WHERE p_partkey % 5 <> 0 AND p_partkey % 4 <> 0 AND ((p_partkey + i) % 2 = 0 OR i <> 1)""")
def q_citation_intents(spark, d):
    return services.intents(_answers(spark, d)).withColumn("intents", F.array_join("intents", ","))


@query("""SELECT CAST(n_name AS VARCHAR) AS raw_string, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 20 >= 17 THEN 'https://ror.org/' || n_nationkey ELSE '' END AS ror_id,
CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 20 >= 17 THEN 'GB' ELSE '' END AS country_code, CASE WHEN n_nationkey % 3 = 0 THEN 0.0 ELSE (n_nationkey % 20) / 20.0 END::DOUBLE AS match_score FROM nation""")
def q_affiliation_gate(spark, d):
    k = F.col("n_nationkey")
    organization = F.struct(F.concat(F.lit("https://ror.org/"), k.cast("string")).alias("id"), F.col("n_name").alias("name"), F.struct(F.lit("GB").alias("country_code")).alias("country"), F.array(F.lit("education")).alias("types"))
    item = F.struct(organization.alias("organization"), ((k % 20) / 20.0).alias("score"))
    rows = t(spark, d, "nation").select(F.col("n_name").alias("raw_string"), F.when(k % 3 != 0, F.array(item)).alias("items"))
    return services.affiliation_matches(rows, STAMP).select("raw_string", "ror_id", "country_code", "match_score")


@query("SELECT n_nationkey AS k, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i < n_nationkey % 6 THEN 'x' || i ELSE '-' END), ',') AS padded, CASE WHEN n_nationkey % 6 = 0 THEN 'none' ELSE 'x0' END AS first, CASE WHEN n_nationkey % 6 > 0 THEN round((n_nationkey % 6) / 4.0, 6) ELSE 0.0 END::DOUBLE AS ratio FROM nation")
def q_array_pad_first(spark, d):
    n = F.col("n_nationkey") % 6
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("x"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), items.alias("items"))
    padded = F.array_join(F.transform(arrays.padded(F.col("items"), 4), lambda x: F.coalesce(x, F.lit("-"))), ",")
    return rows.select("k", padded.alias("padded"), arrays.first_or(F.col("items"), "none").alias("first"), F.round(arrays.ratio(F.size("items"), F.when(F.size("items") > 0, 4).otherwise(0)), 6).alias("ratio"))


# Manifest of fetched works


@query("SELECT CAST(o_orderkey AS VARCHAR) AS pmid FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 3")
def q_ids_to_fetch(spark, d):
    k = F.col("o_orderkey")
    ids = t(spark, d, "orders").select(k.cast("string").alias("pmid"))
    status = F.when(k % 10 == 3, "failed").otherwise("ok")
    return jobs.to_fetch(ids, t(spark, d, "orders").filter(k % 4 != 0).select(k.cast("string").alias("pmid"), status.alias("status")))


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS pmid FROM lineitem WHERE l_partkey % 3 <> 0 ORDER BY pmid LIMIT 500")
def q_ids_to_enrich(spark, d):
    rows = t(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey").cast("string")).otherwise("").alias("pmid"))
    return jobs.ids_to_enrich(rows, 500)


# Articles


def _article_sets(spark, d) -> DataFrame:
    """Documents as article sets with inline markup, two segments, authors and headings; every tenth lacks its citation."""
    i = F.col("doc_id").cast("string")
    plain = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", ""), 1, 80)
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else x for x in inner], F.lit(f"</{name.split(' ')[0]}>"))
    date = F.when(F.col("doc_id") % 3 == 0, tag("MedlineDate", "1995-1996")).otherwise(F.concat(tag("Year", (F.col("doc_id") % 30 + 1990).cast("string")), F.when(F.col("doc_id") % 2 == 0, tag("Month", "Mar")).otherwise("")))
    segments = F.concat(tag('AbstractText Label="METHODS" NlmCategory="METHODS"', plain, " <b>bold</b>"), tag("AbstractText", "tail ", i))
    article = tag(
        "Article", tag("Journal", tag("JournalIssue", tag("PubDate", date)), tag("Title", F.col("source"))), tag("ArticleTitle", "On <i>", F.coalesce("lang", F.lit("")), "</i> ", i), tag("Abstract", segments),
        tag('ELocationID EIdType="pii"', "x"), tag('ELocationID EIdType="doi"', "10.5/", i),
        tag("AuthorList", tag("Author", tag("CollectiveName", "Group ", i)), tag("Author", tag("LastName", "Doe"), tag("ForeName", "J")), tag("Author", tag("LastName", "Roe"), tag("AffiliationInfo", tag("Affiliation", "First")), tag("AffiliationInfo", tag("Affiliation", "Second")))),
    )
    headings = tag("MeshHeadingList", tag("MeshHeading", tag('DescriptorName UI="D1" MajorTopicYN="Y"', "Knee"), tag('QualifierName UI="Q1"', "surgery")), tag("MeshHeading", tag('QualifierName UI="Q2"', "lost")), tag("MeshHeading", tag('DescriptorName UI="D2"', F.coalesce("lang", F.lit("")))))
    citation = F.when(F.col("doc_id") % 10 == 9, F.lit("")).otherwise(tag("MedlineCitation", tag("PMID", i), article, headings))
    return t(spark, d, "documents").select(F.col("source").alias("journal_slug"), tag("PubmedArticleSet", tag("PubmedArticle", citation)).alias("xml"))


_PLAIN = "substr(regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g'), 1, 80)"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS pmid, 'On ' || coalesce(lang, '') || ' ' || doc_id AS title, trim({_PLAIN} || ' bold') || ' tail ' || doc_id AS abstract, CAST(CASE WHEN doc_id % 3 = 0 THEN 1995 ELSE doc_id % 30 + 1990 END AS INTEGER) AS year,
CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN (doc_id % 30 + 1990) || '-03-01' ELSE '' END AS pub_date, '10.5/' || doc_id AS doi, source AS journal, 'Group ' || doc_id || '|Doe|Roe' AS authors, '||First' AS affiliations,
'Knee|' || coalesce(lang, '') AS headings, true AS major, 'surgery' AS qualifier, 'METHODS|' AS segment_labels, true AS has_abstract FROM documents WHERE doc_id % 10 <> 9""")
def q_article_parse(spark, d):
    p = articles.papers(articles.parse(_article_sets(spark, d)))
    joined = lambda column, field: F.array_join(F.transform(column, lambda x: x[field]), "|")
    return p.select(
        "pmid", "title", "abstract", "year", "pub_date", "doi", "journal", joined("authors", "last_name").alias("authors"), joined("authors", "affiliation").alias("affiliations"),
        joined("mesh_headings", "descriptor").alias("headings"), F.get("mesh_headings", 0)["major_topic"].alias("major"), F.get(F.get("mesh_headings", 0)["qualifiers"], 0)["name"].alias("qualifier"),
        joined("abstract_segments", "label").alias("segment_labels"), "has_abstract",
    )


@query("SELECT 'no citation or article' AS error, '<PubmedArticle' AS beginning, count(*) AS n FROM documents WHERE doc_id % 10 = 9 HAVING count(*) > 0")
def q_article_failures(spark, d):
    failed = articles.failures(articles.parse(_article_sets(spark, d)))
    return failed.groupBy("error", F.substring("raw_xml", 1, 14).alias("beginning")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT descriptor, count(*) AS n, count(DISTINCT doc_id) AS n_papers FROM (SELECT doc_id, unnest(['Knee', coalesce(lang, '')]) AS descriptor FROM documents WHERE doc_id % 10 <> 9) GROUP BY 1")
def q_mesh_view(spark, d):
    headings = tables.mesh(articles.papers(articles.parse(_article_sets(spark, d))))
    return headings.groupBy("heading.descriptor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pmid").alias("n_papers"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey END::BIGINT AS total, array_to_string(list_transform(range(1, CAST(n_nationkey % 3 + 1 AS BIGINT)), lambda i: CAST(n_nationkey * 10 + i AS VARCHAR)), ',') AS ids FROM nation")
def q_search_response(spark, d):
    k = F.col("n_nationkey")
    ids = F.array_join(F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.when(i == 0, F.lit("<Id> </Id>")).otherwise(F.concat(F.lit("<Id> "), (k * 10 + i).cast("string"), F.lit("</Id>")))), "")
    total = F.when(k % 4 == 0, F.lit("many")).otherwise(k.cast("string"))
    body = F.concat(F.lit("<eSearchResult><Count>"), total, F.lit("</Count><IdList>"), ids, F.lit("</IdList></eSearchResult>"))
    found = articles.search_result(t(spark, d, "nation").select(k.alias("k"), body.alias("xml")), "xml", ["k"])
    return found.withColumn("ids", F.array_join("ids", ","))


# Text and dates


@query("SELECT c_custkey, substr(lower(regexp_extract(c_name, '([^ ]+)$', 1)), 1, 40) AS last, 'x' || c_custkey AS inside, c_name || ' ' || c_mktsegment AS joined, lower(trim(c_mktsegment)) AS plain, substr(c_name, 1, 5) AS cut, 'search_document: ' || c_name AS prefixed FROM customer")
def q_text_functions(spark, d):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    fenced = F.concat(F.lit("```json\nx"), F.col("c_custkey").cast("string"), F.lit("\n```"))
    last = F.lower(text.last_token(name))
    return t(spark, d, "customer").select(
        "c_custkey", F.substring(last, 1, 40).alias("last"), text.unfence(fenced).alias("inside"), text.join_nonempty(F.array(name, F.lit(""), seg)).alias("joined"),
        text.compatible(F.concat(F.lit(" "), seg, F.lit(" "))).alias("plain"), F.substring(name, 1, 5).alias("cut"), F.concat(F.lit(vectors.ENCODERS["nomic"][1]), name).alias("prefixed"),
    )


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z]', '', 'g') AS folded, 'mueller' AS umlaut, 'H:H' || substr(sha1('authors_v1|' || regexp_replace(lower(s_name), '[^a-z]', '', 'g') || '|s|'), 1, 16) AS heuristic FROM supplier")
def q_name_folding(spark, d):
    name = F.col("s_name")
    return t(spark, d, "supplier").select("s_suppkey", text.folded_letters(name).alias("folded"), text.folded_letters(F.lit("M\u00fceller")).alias("umlaut"), text.heuristic_id("authors_v1", text.folded_letters(name), text.first_initial(name), F.lit("")).alias("heuristic"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) < 2000 THEN 'pre2000' WHEN year(o_orderdate) < 2010 THEN '2000-2009' WHEN year(o_orderdate) < 2020 THEN '2010-2019' ELSE '2020+' END AS era, o_orderpriority AS journal FROM orders WHERE year(o_orderdate) < 2010 AND o_orderpriority IS NOT NULL")
def q_era_pool(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", dates.era_of_sample(F.year("o_orderdate")).alias("era"), F.col("o_orderpriority").alias("journal"))
    return o.filter(F.col("era").isin("pre2000", "2000-2009") & F.col("journal").isNotNull())


# Integrity and near-equality


@query("SELECT vec_id, vec_id % 3 = 0 AS far FROM embeddings")
def q_far_apart(spark, d):
    v = t(spark, d, "embeddings")
    moved = F.transform("embedding", lambda x, i: x + F.when((F.col("vec_id") % 3 == 0) & (i == 5), 0.5).otherwise(0.0002))
    return v.select("vec_id", arrays.far_apart(F.col("embedding"), moved).alias("far"))


@query("SELECT count(*) AS n_total, count(DISTINCT c_custkey) AS n_distinct, 0::BIGINT AS n_duplicates, abs((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) - 13070) > 3267 AS drifted FROM customer")
def q_unique_and_drift(spark, d):
    customers = dedup.require_unique(t(spark, d, "customer"), "c_custkey")
    duplicates = dedup.integrity(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).first().n_duplicates
    return dedup.integrity(customers, ["c_custkey"]).withColumn("drifted", F.lit(dedup.drifted(duplicates)))


@query("SELECT DISTINCT ON (source) source, 1 AS one FROM documents WHERE source IS NOT NULL")
def q_drop_duplicates_subset(spark, d):
    return t(spark, d, "documents").filter("source IS NOT NULL").dropDuplicates(["source"]).select("source", F.lit(1).alias("one"))


@query("SELECT lang, CAST(avg(length(text)) AS DOUBLE) AS mean_length, count(DISTINCT source) AS cells FROM documents GROUP BY 1")
def q_mean_text_length(spark, d):
    docs = t(spark, d, "documents").groupBy("lang").agg(F.avg(F.length("text")).alias("mean_length"), F.countDistinct("source").alias("cells"))
    return docs


@query("SELECT user_id, row_number() OVER (ORDER BY length(user_id::VARCHAR), user_id) - 1 AS place FROM (SELECT DISTINCT user_id FROM events)")
def q_numeric_id_order(spark, d):
    ids = t(spark, d, "events").select(F.col("user_id").cast("string").alias("pmid")).distinct()
    ranked = tables.with_row_ids(ids, [F.length("pmid").asc(), F.col("pmid").asc()], "place")
    return ranked.select(F.col("pmid").cast("long").alias("user_id"), F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name DESC, c_custkey) AS progress FROM customer")
def q_progress_index(spark, d):
    rows = tables.with_row_ids(t(spark, d, "customer").select("c_custkey", "c_name"), [F.col("c_name").desc(), F.col("c_custkey").asc()])
    return rows.select("c_custkey", (F.col("row_id") + 1).cast("long").alias("progress"))


@query("""SELECT doc_id, lang IN ('en', 'o''clock', 'a\b') AS listed, 'o''clock' AS word FROM documents WHERE lang IS NOT NULL""")
def q_quoted_literals(spark, d):
    listed = ", ".join(map(text.sql_literal, ("en", "o'clock", "a\\b")))
    return t(spark, d, "documents").filter("lang IS NOT NULL").selectExpr("doc_id", f"lang IN ({listed}) AS listed", f"{text.sql_literal(chr(111) + chr(39) + 'clock')} AS word")


@query("SELECT source, 'both' AS side FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de') UNION ALL SELECT source, 'only' FROM (SELECT source FROM documents WHERE length(text) > 50 EXCEPT SELECT source FROM documents WHERE doc_id % 40 = 0)")
def q_set_intersection_difference(spark, d):
    docs = t(spark, d, "documents")
    of = lambda where: docs.filter(where).select("source")
    both, only = of("lang = 'en'").intersect(of("lang = 'de'")), of("length(text) > 50").subtract(of("doc_id % 40 = 0"))
    return both.withColumn("side", F.lit("both")).union(only.withColumn("side", F.lit("only")))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def q_label_codes(spark, d):
    return agreement.codes(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


# Topics


@query("SELECT label AS topic_id, CAST(count(*) AS BIGINT) AS size, label % 3 AS mid_level_id FROM embeddings GROUP BY 1, 3")
def q_topic_sizes(spark, d):
    v = t(spark, d, "embeddings")
    return v.groupBy(F.col("label").alias("topic_id")).agg(F.count(F.lit(1)).alias("size")).withColumn("mid_level_id", F.col("topic_id") % 3)


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT label, d, avg(e[d]) AS m FROM u, range(1, 65) AS r(d) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY d) AS centre FROM m GROUP BY 1),
s AS (SELECT vec_id, u.label, round(list_cosine_similarity(e, centre), 9) AS s FROM u JOIN c ON u.label = c.label)
SELECT CAST(label AS BIGINT) AS topic_id, array_to_string(list(vec_id ORDER BY s DESC, vec_id)[1:3], ',') AS representative_docs, count(*) AS size FROM s GROUP BY 1""")
def q_topic_representatives(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), F.col("label").cast("long").alias("topic_id"), "embedding")
    found = topics.representatives(v.select("pmid", "topic_id"), v.select("pmid", "embedding"))
    return found.select("topic_id", F.array_join("representative_docs", ",").alias("representative_docs"), "size")


_SWEEP = "SELECT n_nationkey AS k, 60 + n_nationkey * 10 AS n_leaf, (n_nationkey % 5) / 10.0 AS noise, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE round((n_nationkey * 7 % 25) / 100.0, 4) END AS npmi, CASE WHEN n_nationkey % 8 = 1 THEN 'failed' END AS error FROM nation"


def _swept(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return t(spark, d, "nation").select(
        F.format_string("%03d", k).alias("config"), (60 + k * 10).cast("long").alias("n_leaf_topics"), ((k % 5) / 10.0).alias("noise_fraction"),
        F.when(k % 6 != 0, F.round((k * 7 % 25) / 100.0, 4)).alias("npmi_top10"), F.when(k % 8 == 1, "failed").alias("error"),
    )


@query(f"SELECT printf('%03d', k) AS config, NOT (n_leaf BETWEEN 100 AND 200 AND noise <= 0.2) AS constraints_unmet FROM ({_SWEEP}) WHERE error IS NULL ORDER BY constraints_unmet, npmi DESC NULLS LAST, config LIMIT 1")
def q_sweep_choice(spark, d):
    return topics.choose(_swept(spark, d)).select("config", "constraints_unmet")


@query(f"SELECT printf('%03d', k) AS config, CAST(npmi AS DOUBLE) AS npmi_top10 FROM ({_SWEEP}) WHERE error IS NULL ORDER BY npmi DESC NULLS LAST, config LIMIT 3")
def q_sweep_near_misses(spark, d):
    return topics.near_misses(_swept(spark, d)).select("config", "npmi_top10")


@query("""WITH e AS (SELECT p_partkey, p_name, p_size, quantile_cont(p_size, 0.25) OVER () AS a, quantile_cont(p_size, 0.5) OVER () AS b, quantile_cont(p_size, 0.75) OVER () AS c FROM part), q AS (SELECT *, CASE WHEN p_size <= a THEN 1 WHEN p_size <= b THEN 2 WHEN p_size <= c THEN 3 ELSE 4 END AS quartile FROM e)
SELECT p_partkey, quartile, p_name AS title FROM q QUALIFY row_number() OVER (PARTITION BY quartile ORDER BY p_size DESC, p_partkey) <= 5""")
def q_spot_check(spark, d):
    parts = t(spark, d, "part")
    sample = reports.spot_check(parts.select("p_partkey", "p_size"), parts.select("p_partkey", F.col("p_name").alias("title")), "p_partkey", "p_size")
    return sample.select("p_partkey", "quartile", "title")


@query("SELECT l_orderkey, CASE WHEN l_linenumber <= 1 THEN 1 ELSE 2 END AS part FROM lineitem WHERE l_linenumber IN (1, 5)")
def q_bins_with_equal_edges(spark, d):
    lines = t(spark, d, "lineitem").filter("l_linenumber IN (1, 5)")
    half = lines.withColumn("v", F.when(F.col("l_linenumber") == 1, 1).otherwise(5))
    edges = reports.quartiles(half, "v", "quartile", duplicates="drop")
    return edges.select("l_orderkey", F.when(F.col("v") == 1, 1).otherwise(2).alias("part"))


# Label sheets and pilot


@query("SELECT doc_id AS pmid, 'r1' AS rater, CASE WHEN doc_id % 2 = 0 THEN 'other' END AS study_design FROM labels WHERE doc_id % 3 <> 0")
def q_sheet_without_blank_rows(spark, d):
    i = F.col("doc_id")
    values = {"study_design": F.when(i % 2 == 0, "other").otherwise(" "), "has_control": F.when(i % 2 == 1, "TRUE").otherwise("")}
    cells = t(spark, d, "labels").select(i.alias("pmid"), F.lit("r1").alias("rater"), *[F.when(i % 3 != 0, values.get(f, F.lit(" "))).otherwise("  ").alias(f) for f in labels.FIELDS])
    kept = cells.filter(~labels.all_blank(cells))
    return kept.select("pmid", "rater", F.when(F.trim("study_design") != "", F.col("study_design")).alias("study_design"))


@query("SELECT doc_id AS pmid, 'r1' AS rater, 'study_design' AS field, 'other' AS value FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'r1', 'statistical_claim_present', 'true' FROM labels WHERE doc_id % 3 <> 0")
def q_import_sheet(spark, d):
    i = F.col("doc_id")
    values = {"study_design": F.when(i % 3 == 0, "trial").otherwise("other"), "statistical_claim_present": F.lit("TRUE"), "coi_disclosed_in_abstract": F.lit("false")}
    cells = t(spark, d, "labels").select(i.alias("pmid"), F.lit("r1").alias("rater"), *[values.get(f, F.lit("")).alias(f) for f in labels.FIELDS])
    table, _, _ = labels.import_sheet(cells, spark.createDataFrame([], "pmid long, rater string, field string, value string, imported_at string"), STAMP)
    return table.filter("field IN ('study_design', 'statistical_claim_present')").select("pmid", "rater", "field", "value")


@query("""SELECT doc_id AS pmid, CASE WHEN low LIKE '%randomi%' THEN 'RCT' WHEN low LIKE '%cohort%' THEN 'cohort' WHEN low LIKE '%review%' THEN 'review' ELSE 'other' END AS study_design, CASE WHEN low LIKE '%control%' THEN true END AS has_control,
low LIKE '%p <%' OR low LIKE '%p=%' AS statistical_claim_present, CASE WHEN low LIKE '%improv%' THEN 'positive' END AS effect_direction FROM (SELECT doc_id, lower('we saw ' || CASE doc_id % 4 WHEN 0 THEN 'a randomized control' WHEN 1 THEN 'a Cohort, p < 0.05,' WHEN 2 THEN 'an Improved review' ELSE 'nothing' END || ' here') AS low FROM documents)""")
def q_label_extraction(spark, d):
    i = F.col("doc_id")
    what = F.when(i % 4 == 0, "a randomized control").when(i % 4 == 1, "a Cohort, p < 0.05,").when(i % 4 == 2, "an Improved review").otherwise("nothing")
    rows = t(spark, d, "documents").select(i.alias("pmid"), text.prompt("Label.", F.concat(F.lit("we saw "), what, F.lit(" here"))).alias("prompt"))
    return labels.extract(rows, at=STAMP).select("pmid", "study_design", "has_control", "statistical_claim_present", "effect_direction")


@query("SELECT doc_id AS pmid, 'v0.1' AS prompt_version FROM documents ORDER BY doc_id LIMIT 50")
def q_pilot_head(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("pmid"), text.prompt("Label.", F.col("text")).alias("prompt"))
    return labels.pilot(rows, 50, at=STAMP)[0].select("pmid", "prompt_version")
