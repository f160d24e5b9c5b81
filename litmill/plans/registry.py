"""Registered queries over the test tables, each with its SQL where SQL can express it.

The bibliographic tables are stood in for by the test tables: documents for papers with abstracts, orders for papers
with years, lineitem for duplicates and references, part for works, labels for two raters, events for buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import arrays, dates, text
from litmill.operators import agreement, dedup, labels, reports, resolve, roadmap, topics, vectors
from litmill.plans.register import QUERIES, SQL, query, t
from litmill.sources import tables

def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers: pmid, journal_slug, year."""
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmid"), F.col("o_orderpriority").alias("journal_slug"), F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderstatus", "o_custkey")


ERA_SQL = "CASE WHEN year(o_orderdate) < 2000 THEN 'pre-2000' WHEN year(o_orderdate) BETWEEN 2000 AND 2009 THEN '2000-2009' WHEN year(o_orderdate) BETWEEN 2010 AND 2019 THEN '2010-2019' WHEN year(o_orderdate) >= 2020 THEN '2020+' ELSE 'unknown' END"
TOKENS_SQL = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 2)"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


# Scans, projections, filters


@query("SELECT count(*) AS n_docs, count(DISTINCT doc_id) AS n_ids, count(DISTINCT CASE WHEN text IS NOT NULL AND length(text) > 50 THEN doc_id END) AS n_with_text FROM documents")
def q_total_counts(spark, d):
    return t(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("doc_id").alias("n_ids"), F.countDistinct(F.when(text.has_text(F.col("text")), F.col("doc_id"))).alias("n_with_text"))


@query("SELECT source, lang, count(*) AS n_papers FROM documents GROUP BY 1, 2")
def q_journals_view(spark, d):
    return reports.count_by(t(spark, d, "documents"), "source", "lang", name="n_papers")


@query("SELECT o_orderpriority AS journal_slug, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2")
def q_trend_by_year(spark, d):
    return reports.trend(_papers(spark, d), "journal_slug")


@query(f"SELECT o_orderpriority AS journal_slug, {ERA_SQL} AS era, CAST(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS rate FROM orders GROUP BY 1, 2")
def q_abstract_availability_era(spark, d):
    return reports.rate_by_era(_papers(spark, d), "journal_slug", F.col("o_totalprice") > 100000)


@query("""SELECT o_orderpriority AS journal_slug, CAST(avg(CASE WHEN year(o_orderdate) < 2000 THEN CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END END) AS DOUBLE) AS pre_2000,
CAST(avg(CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2009 THEN CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END END) AS DOUBLE) AS y2000s FROM orders GROUP BY 1""")
def q_availability_pivot(spark, d):
    long = reports.rate_by_era(_papers(spark, d), "journal_slug", F.col("o_totalprice") > 100000)
    wide = reports.matrix(long, "journal_slug", "era", "rate", dates.ERAS_OF_REPORT)
    return wide.select("journal_slug", F.col("`pre-2000`").alias("pre_2000"), F.col("`2000-2009`").alias("y2000s"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 50")
def q_abstract_filter(spark, d):
    return t(spark, d, "documents").filter(text.has_text(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, source AS journal, '. ' AS joint, coalesce(source, '') || '. ' || coalesce(text, '') AS document, 'mpnet' AS model_name, coalesce(source IN ('src0', 'src1'), false) AS listed FROM documents")
def q_project_rename_concat(spark, d):
    document = text.title_and_abstract(F.col("source"), F.col("text"))
    listed = F.coalesce(F.col("source").isin("src0", "src1"), F.lit(False))
    return t(spark, d, "documents").select("doc_id", F.col("source").alias("journal"), F.lit(". ").alias("joint"), document.alias("document"), F.lit("mpnet").alias("model_name"), listed.alias("listed"))


@query("SELECT doc_id, CAST(CAST(doc_id AS VARCHAR) AS BIGINT) AS pmid, label = 3 AS is_noise FROM documents JOIN embeddings ON doc_id = vec_id")
def q_cast_and_flag(spark, d):
    joined = t(spark, d, "documents").join(t(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return joined.select("doc_id", F.col("doc_id").cast("string").cast("bigint").alias("pmid"), (F.col("label") == 3).alias("is_noise"))


@query("WITH l AS (SELECT length(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL), e AS (SELECT min(v) lo, max(v) hi FROM l) SELECT CAST(least(floor((v - lo) / CASE WHEN hi > lo THEN (hi - lo) / 60 ELSE 1.0 END) + 1, 60) AS INTEGER) AS bin, count(*) AS n FROM l, e GROUP BY 1")
def q_length_histogram(spark, d):
    return reports.histogram(t(spark, d, "documents"), F.length("text"))


@query("SELECT CAST(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS rate, count(*) AS n FROM orders WHERE year(o_orderdate) < 2000")
def q_pre2000_rate(spark, d):
    return _papers(spark, d).filter("year < 2000").agg(F.avg(arrays.indicator(F.col("o_totalprice") > 100000)).alias("rate"), F.count(F.lit(1)).alias("n"))


# Deduplication and integrity


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def q_distinct_latest(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dedup.first_per_key(rows, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), *map(F.asc, ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))])


@query("SELECT doc_id, source, length(text) AS n FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r = 1")
def q_longest_text_per_source(spark, d):
    rows = dedup.first_per_key(t(spark, d, "documents"), ["source"], [F.length("text").desc_nulls_last(), F.asc("doc_id")])
    return rows.select("doc_id", "source", F.length("text").cast("long").alias("n"))


@query("SELECT count(*) AS n_total, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicates FROM lineitem")
def q_integrity_counts(spark, d):
    return dedup.integrity(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def q_vector_dedup(spark, d):
    v = t(spark, d, "embeddings")
    doubled = v.withColumn("ordinal", F.lit(0)).unionByName(v.filter("vec_id % 7 = 0").withColumn("ordinal", F.lit(1)))
    return dedup.distinct_vectors(doubled, "vec_id").select("vec_id", "label", F.size("embedding").alias("dim"))


@query("SELECT doc_id, min(o) AS lang_order FROM (SELECT doc_id, 0 AS o FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE length(text) > 200 UNION ALL SELECT doc_id, 2 FROM documents WHERE lang <> 'en') GROUP BY 1")
def q_union_dedup_first(spark, d):
    docs = t(spark, d, "documents")
    parts = [docs.filter("lang = 'en'"), docs.filter("length(text) > 200"), docs.filter("lang <> 'en'")]
    return dedup.united_first([p.select("doc_id", F.lit(i).alias("lang_order")) for i, p in enumerate(parts)], "doc_id", "lang_order")


# Joins


@query("SELECT count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE year(o_orderdate) >= 2000 AND l_quantity > 25")
def q_refs_post2000(spark, d):
    refs = t(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("pmid"))
    return _papers(spark, d).filter("year >= 2000").join(refs, "pmid").agg(F.countDistinct("pmid").alias("n"))


_EXISTS = f"""SELECT o_orderpriority AS journal_slug, {ERA_SQL} AS era, CAST(avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS any_reference,
CAST(avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS any_author FROM orders GROUP BY 1, 2"""


@query(f"SELECT journal_slug, era, metric, rate FROM ({_EXISTS}) UNPIVOT (rate FOR metric IN (any_reference, any_author))")
def q_coverage_exists(spark, d):
    lines = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "pmid")
    return reports.coverage(_papers(spark, d), {"any_reference": lines.filter("l_quantity > 45"), "any_author": lines.filter("l_returnflag = 'R'")}, "journal_slug", "year")


@query(f"SELECT o_orderpriority AS journal_slug, {ERA_SQL} AS era, CAST(avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 45) THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS rate FROM orders GROUP BY 1, 2")
def q_coverage_exists_join(spark, d):
    keys = t(spark, d, "lineitem").join(t(spark, d, "part").filter("p_size > 45"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("pmid"))
    return reports.coverage(_papers(spark, d), {"m": keys}, "journal_slug", "year").drop("metric")


@query("SELECT doc_id, source, CAST(label AS BIGINT) AS topic_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def q_left_join_topics(spark, d):
    topic = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("topic_id"))
    return t(spark, d, "documents").join(topic, "doc_id", "left").select("doc_id", "source", "topic_id")


@query("SELECT vec_id, e.label, source, lang, s.size FROM embeddings e LEFT JOIN documents ON vec_id = doc_id LEFT JOIN (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) s ON e.label = s.label")
def q_two_step_left_join(spark, d):
    v, docs = t(spark, d, "embeddings"), t(spark, d, "documents")
    sizes = reports.count_by(v, "label", name="size")
    return v.join(docs, F.col("vec_id") == F.col("doc_id"), "left").join(sizes, "label", "left").select("vec_id", "label", "source", "lang", "size")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_semi_id_list(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_anti_missing(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT avg(CASE WHEN quality IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS missing_percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_missing_rate(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").agg((F.avg(arrays.indicator(F.col("quality").isNull())) * 100).alias("missing_percent"))


@query("SELECT l_orderkey AS citing_pmid, l_partkey AS ref_openalex_id, coalesce(p_partkey + 1000000, 0) AS ref_pmid_if_known, coalesce(p_size, 0) AS ref_year, l_linenumber AS ref_position FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def q_internal_citations(spark, d):
    refs = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing_pmid"), F.col("l_partkey").alias("ref_openalex_id"), F.lit(0).cast("long").alias("ref_pmid_if_known"), F.lit(0).alias("ref_year"), F.col("l_linenumber").alias("ref_position"))
    works = t(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("openalex_id"), (F.col("p_partkey") + 1000000).alias("pmid"), F.col("p_size").alias("publication_year"))
    return reports.internal_citations(refs, works)


# Terms


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS total FROM documents) SELECT term, count(DISTINCT doc_id) AS n FROM w, n GROUP BY term, total HAVING 100.0 * count(DISTINCT doc_id) / total <= 25 ORDER BY n DESC, term LIMIT 50")
def q_mesh_having_ratio(spark, d):
    return reports.frequent_words(t(spark, d, "documents"), text.tokens(F.col("text"), []), "doc_id", 25.0, 50)


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents), f AS (SELECT term, count(*) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)
SELECT doc_id, term FROM w JOIN f USING (term) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n, term) = 1""")
def q_rarest_label(spark, d):
    docs = labels.merged_sets(t(spark, d, "documents"), topics.term_list("text", stop_words=[]), "doc_id", "terms")
    return labels.rarest_of_sets(docs, F.col("terms"), "doc_id", "term", rows_each=0)[1]


@query(f"SELECT doc_id, len(list_filter({TOKENS_SQL}, lambda x: x NOT IN {STOP_SQL})) AS n_tokens, array_to_string(list_filter({TOKENS_SQL}, lambda x: x NOT IN {STOP_SQL})[1:5], ' ') AS first_five FROM documents")
def q_tokenize(spark, d):
    docs = t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join(F.slice("w", 1, 5), " ").alias("first_five"))


@query(f"SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents")
def q_explode_terms(spark, d):
    return topics.terms(t(spark, d, "documents"), "doc_id", stop_words=[])


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS ref_position, w[i] AS ref FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents WHERE text IS NOT NULL) WHERE w[i] <> ''")
def q_posexplode_refs(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ref_position", "ref"))
    return docs.filter("ref <> ''")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY 1")
def q_doc_frequency(spark, d):
    return t(spark, d, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text"), []))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _topic_docs(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic_id"))
    return t(spark, d, "documents").select("doc_id", "text").join(v, "doc_id")


_CTFIDF = f"""w AS (SELECT label AS topic_id, unnest({TOKENS_SQL}) AS term FROM documents JOIN embeddings ON doc_id = vec_id), tf AS (SELECT topic_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY 1, 2),
s AS (SELECT topic_id, sum(tf) AS words FROM tf GROUP BY 1), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1), a AS (SELECT avg(words) AS a FROM s),
c AS (SELECT topic_id, term, round(tf / words * ln(1 + a / f), 8) AS weight FROM tf JOIN s USING (topic_id) JOIN f USING (term), a),
top AS (SELECT topic_id, term, weight, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 10)"""


@query(f"WITH {_CTFIDF} SELECT topic_id, term, weight, rank FROM top")
def q_ctfidf_top10(spark, d):
    return topics.top_words(topics.class_weights(_topic_docs(spark, d), key="doc_id", stop_words=[]))


@query(f"""WITH {_CTFIDF}, p AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents JOIN embeddings ON doc_id = vec_id), q AS (SELECT p.* FROM p JOIN (SELECT DISTINCT term FROM top) USING (term)),
n AS (SELECT count(DISTINCT vec_id)::DOUBLE AS d FROM embeddings JOIN documents ON doc_id = vec_id), sg AS (SELECT term, count(*)::DOUBLE AS n FROM q GROUP BY 1),
pairs AS (SELECT x.topic_id, x.term AS a, y.term AS b FROM top x JOIN top y ON x.topic_id = y.topic_id AND x.term < y.term),
ab AS (SELECT a, b, count(*)::DOUBLE AS nab FROM (SELECT DISTINCT a, b FROM pairs) JOIN q x ON x.term = a JOIN q y ON y.term = b AND x.doc_id = y.doc_id GROUP BY 1, 2),
v AS (SELECT topic_id, coalesce(nab, 0) / d + 1e-12 AS pab, sa.n / d * (sb.n / d) AS e FROM pairs LEFT JOIN ab USING (a, b) JOIN sg sa ON sa.term = a JOIN sg sb ON sb.term = b, n)
SELECT topic_id, round(avg(CASE WHEN abs(ln(pab)) < 1e-9 THEN 1.0 ELSE ln(pab / e) / -ln(pab) END), 6) AS npmi FROM v GROUP BY 1""")
def q_npmi(spark, d):
    docs = _topic_docs(spark, d)
    return topics.npmi_of_documents(topics.top_words(topics.class_weights(docs, key="doc_id", stop_words=[])), docs, key="doc_id")


# Topics and shares


@query("SELECT label AS topic_id, count(*) AS size, CAST(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS noise FROM embeddings GROUP BY 1")
def q_topic_sizes_noise(spark, d):
    return t(spark, d, "embeddings").groupBy(F.col("label").alias("topic_id")).agg(F.count(F.lit(1)).alias("size"), F.avg(arrays.indicator(F.col("label") == 0)).alias("noise"))


@query("""WITH r AS (SELECT label, lang FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang IS NOT NULL AND label IS NOT NULL), g AS (SELECT * FROM (SELECT DISTINCT label FROM r), (SELECT DISTINCT lang FROM r)), c AS (SELECT label, lang, count(*) AS n FROM r GROUP BY 1, 2)
SELECT label, lang, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY lang), 12) AS share FROM g LEFT JOIN c USING (label, lang)""")
def q_topic_share(spark, d):
    rows = t(spark, d, "embeddings").join(t(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    return reports.shares(rows, "label", "lang").withColumn("share", F.round("share", 12))


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) q1, quantile_cont(p_retailprice, 0.5) q2, quantile_cont(p_retailprice, 0.75) q3 FROM part), q AS (SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice <= q1 THEN 1 WHEN p_retailprice <= q2 THEN 2 WHEN p_retailprice <= q3 THEN 3 ELSE 4 END AS quartile FROM part, e)
SELECT p_partkey, quartile FROM q QUALIFY row_number() OVER (PARTITION BY quartile ORDER BY p_retailprice DESC, p_partkey) <= 5""")
def q_quartile_topk(spark, d):
    parts = reports.quartiles(t(spark, d, "part"), "p_retailprice")
    return reports.top_per_group(parts, ["quartile"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5).select("p_partkey", "quartile")


@query("SELECT size, count(*) AS n FROM (SELECT source, count(*) AS size FROM documents GROUP BY 1) GROUP BY 1")
def q_value_counts_of_counts(spark, d):
    return reports.counts_of_counts(t(spark, d, "documents"), "source")


@query("SELECT source, count(CASE WHEN lang = 'de' THEN 1 END) AS de, count(CASE WHEN lang = 'en' THEN 1 END) AS en, count(CASE WHEN lang = 'es' THEN 1 END) AS es, count(CASE WHEN lang = 'fr' THEN 1 END) AS fr FROM documents GROUP BY 1")
def q_size_unstack(spark, d):
    return t(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


# Entities


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ORCID:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'OA:' || c_custkey ELSE 'H:H' || substr(sha1('authors_v1|' || regexp_replace(lower(c_name), '[^a-z]', '', 'g') || '|' || substr(regexp_replace(lower(c_name), '[^a-z]', '', 'g'), 1, 1) || '|' || c_nationkey), 1, 16) END AS canonical_id FROM customer""")
def q_author_canonical(spark, d):
    c = t(spark, d, "customer")
    own = F.col("c_custkey").cast("string")
    pick = lambda r: F.when(F.col("c_custkey") % 3 == r, own).otherwise("")
    return c.select("c_custkey", resolve.canonical_id(pick(0), pick(1), text.folded_letters(F.col("c_name")), text.first_initial(F.col("c_name")), F.col("c_nationkey").cast("string")).alias("canonical_id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, bool_and(is_first) AS is_first, bool_and(is_last) AS is_last FROM (SELECT *, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_first, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_last FROM lineitem) GROUP BY 1, 2")
def q_first_last_flags(spark, d):
    rows = t(spark, d, "lineitem").withColumn("label", F.lit(""))
    flags = resolve.position_flags(rows, "l_orderkey", "l_linenumber", "label")
    return flags.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_first").alias("is_first"), F.bool_and("is_last").alias("is_last"))


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first_at) = 1")
def q_mode_first_seen(spark, d):
    return reports.mode_first_seen(t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'OA:' || s_nationkey ELSE 'RAW:' || substr(sha1(regexp_replace(lower(trim(n_name)), '\\s+', ' ', 'g')), 1, 16) END AS institution_canonical_id, arg_min(n_name, s_suppkey) AS display_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def q_institution_dedup(spark, d):
    rows = t(spark, d, "supplier").join(F.broadcast(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("I"), F.col("s_nationkey").cast("string"))).otherwise("")
    inst = F.array(F.struct(F.regexp_replace(own, "^I", "").alias("oa_id"), F.lit("").alias("ror_id"), F.col("n_name").alias("display_name"), F.lit("").alias("country_code"), F.lit("").alias("type")))
    staging = rows.select(F.lpad(F.col("s_suppkey").cast("string"), 12, "0").alias("pmid"), F.lit(0).alias("author_position"), inst.alias("institutions"), F.array().cast("array<string>").alias("raw_affiliation_strings"))
    cache = spark.createDataFrame([], "raw_string string, ror_id string, ror_display_name string, country_code string, type string, match_score double, fetched_at string")
    table, links = resolve.institutions(staging, cache)
    return table.join(reports.count_by(links, "institution_canonical_id"), "institution_canonical_id").select("institution_canonical_id", "display_name", "n")


@query("SELECT page_id, CASE WHEN starts_with(trim(coalesce(url, '')), 'https://') THEN substr(trim(url), 9) ELSE trim(coalesce(url, '')) END AS bare, substr(sha1(url), 1, 16) AS digest FROM pages")
def q_strip_prefix(spark, d):
    return t(spark, d, "pages").select("page_id", text.strip_prefix(F.col("url"), "https://").alias("bare"), text.short_hash(F.col("url")).alias("digest"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m') || '-01' AS month_only, CAST(regexp_extract('issued ' || year(o_orderdate) || '-' || (year(o_orderdate) + 1), '\\b(\\d{4})\\b', 1) AS INTEGER) AS found FROM orders")
def q_iso_date(spark, d):
    y, when_ = F.year("o_orderdate"), F.col("o_orderdate")
    o = t(spark, d, "orders")
    return o.select(
        "o_orderkey", dates.iso_date(y, F.date_format(when_, "MMMM"), F.dayofmonth(when_).cast("string")).alias("iso"), dates.iso_date(y, F.month(when_).cast("string"), F.lit("")).alias("month_only"),
        dates.year_within(F.concat(F.lit("issued "), y.cast("string"), F.lit("-"), (y + 1).cast("string"))).alias("found"),
    )


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages")
def q_html_extract(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n"))


# Vectors


_SIMS = "SELECT a.vec_id AS q, b.vec_id AS n, a.label AS ql, b.label AS nl, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id"


@query(f'SELECT q AS "query", n AS neighbour, CAST(r AS INTEGER) AS rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS r FROM ({_SIMS}) WHERE q % 50 = 0) WHERE r <= 10')
def q_knn_topk(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), "embedding")
    return vectors.nearest(v, v.filter("pmid % 50 = 0")).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT round(avg(p), 9) AS precision FROM (SELECT q, avg(CASE WHEN ql = nl THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS r FROM ({_SIMS})) WHERE r <= 10 GROUP BY 1)")
def q_knn_precision(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), "embedding", "label")
    return vectors.label_precision(vectors.nearest(v, v), v).select(F.round("precision", 9).alias("precision"))


@query("""WITH s AS (SELECT a.vec_id = b.vec_id AS me, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b)
SELECT round(avg(CASE WHEN same AND NOT me THEN s END), 6) AS intra, round(avg(CASE WHEN NOT same OR me THEN s END), 6) AS inter, round(avg(CASE WHEN same AND NOT me THEN s END) - avg(CASE WHEN NOT same OR me THEN s END), 6) AS separation FROM s""")
def q_intra_inter(spark, d):
    s = vectors.separation(t(spark, d, "embeddings"))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("WITH s AS (SELECT source AS model, round(avg(length(text)) / 10000, 6) AS score FROM documents GROUP BY 1), b AS (SELECT max(score) AS base FROM s WHERE model = 'src1'), t AS (SELECT model AS bm, score AS bs FROM s ORDER BY score DESC, model LIMIT 1) SELECT CASE WHEN bs - base >= 0.03 THEN bm ELSE 'src1' END AS model, CASE WHEN bs - base >= 0.03 THEN bs ELSE base END AS score FROM t, b")
def q_model_selection(spark, d):
    scores = t(spark, d, "documents").groupBy(F.col("source").alias("model")).agg(F.round(F.avg(F.length("text")) / 10000, 6).alias("score"))
    return vectors.choose_model(scores, "src1").select("model", "score")


# Samples and labels


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), e AS (SELECT *, n * (200.0::DOUBLE / sum(n) OVER ()) AS x FROM c), p AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, n DESC, source, lang) AS place, 200 - sum(floor(x)) OVER () AS spare FROM e)
SELECT source, lang, n, CAST(floor(x) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS seats FROM p""")
def q_hare_allocation(spark, d):
    return labels.seats_frame(reports.count_by(t(spark, d, "documents"), "source", "lang"), 200)


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY md5('42|' || doc_id), doc_id) <= 3")
def q_stratified_sample(spark, d):
    return labels.hashed_sample(t(spark, d, "documents"), ["source", "lang"], "doc_id", 3).select("doc_id", "source", "lang")


_AGREE = """WITH p AS (SELECT {f} AS field, quality AS a, toxic AS b FROM {t} WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT field, count(*)::DOUBLE AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE AS agree FROM p GROUP BY 1),
l AS (SELECT field, v, sum(x) AS na, sum(y) AS nb FROM (SELECT field, a AS v, 1 AS x, 0 AS y FROM p UNION ALL SELECT field, b, 0, 1 FROM p) GROUP BY 1, 2), m AS (SELECT field, sum(na * nb)::DOUBLE AS ab, sum((na + nb) * (na + nb))::DOUBLE AS c2 FROM l GROUP BY 1)
SELECT field, CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS n_agree, round((agree / n - ab / (n * n)) / (1 - ab / (n * n)), 9) AS kappa, round(1 - (2 * n - 1) * 2 * (n - agree) / (4 * n * n - c2), 9) AS alpha FROM n JOIN m USING (field)"""


@query(_AGREE.format(f="'all'", t="labels"))
def q_kappa_alpha(spark, d):
    s = agreement.summary(t(spark, d, "labels").withColumn("field", F.lit("all")), a="quality", b="toxic")
    return s.withColumn("kappa", F.round("kappa", 9)).withColumn("alpha", F.round("alpha", 9))


@query(_AGREE.format(f="lang", t="labels JOIN documents USING (doc_id)"))
def q_field_summary(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").withColumn("field", F.col("lang"))
    s = agreement.summary(rows, a="quality", b="toxic")
    return s.withColumn("kappa", F.round("kappa", 9)).withColumn("alpha", F.round("alpha", 9))


@query("SELECT count(*) AS n, round(2 * covar_pop(l_quantity, l_extendedprice / 1000) / (var_pop(l_quantity) + var_pop(l_extendedprice / 1000) + pow(avg(l_quantity) - avg(l_extendedprice / 1000), 2)), 8) AS ccc FROM lineitem")
def q_ccc(spark, d):
    rows = t(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    return agreement.concordance(rows, "l_quantity", "y").withColumn("ccc", F.round("ccc", 8))


@query("SELECT doc_id AS pmid, 'r1' AS rater, field, value FROM (SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(nullif(toxic, 0) AS VARCHAR) AS toxic FROM labels) UNPIVOT INCLUDE NULLS (value FOR field IN (quality, toxic))")
def q_long_unpivot(spark, d):
    rows = t(spark, d, "labels").select(F.col("doc_id").alias("pmid"), F.lit("r1").alias("rater"), F.col("quality").cast("string").alias("quality"), F.nullif(F.col("toxic"), F.lit(0)).cast("string").alias("toxic"))
    return rows.unpivot(["pmid", "rater"], ["quality", "toxic"], "field", "value")


@query("SELECT doc_id AS pmid, 'r1' AS rater, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS value FROM labels")
def q_upsert_labels(spark, d):
    old = t(spark, d, "labels").select(F.col("doc_id").alias("pmid"), F.lit("r1").alias("rater"), F.col("quality").alias("value"))
    new = old.filter("pmid % 4 = 0").withColumn("value", 1 - F.col("value"))
    return tables.upsert(old, new, ["pmid", "rater"])


_CELLS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'RCT' WHEN 1 THEN 'cohort' WHEN 2 THEN 'trial' ELSE 'other' END AS design, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '-3' WHEN 2 THEN '12.0' ELSE '40' END AS size, CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' ELSE 'maybe' END AS claim FROM labels"


@query(f"SELECT doc_id AS pmid, CASE WHEN design NOT IN ('RCT', 'cohort', 'case_control', 'case_series', 'review', 'other') THEN 'study_design' WHEN size = '-3' THEN 'sample_size' WHEN claim = 'maybe' THEN 'statistical_claim_present' END AS reason, CASE WHEN size = '' THEN NULL ELSE CAST(CAST(size AS DOUBLE) AS BIGINT) END AS sample_size FROM ({_CELLS})")
def q_label_validation(spark, d):
    i = F.col("doc_id")
    cells = t(spark, d, "labels").select(
        i.alias("pmid"), F.when(i % 5 == 0, "RCT").when(i % 5 == 1, "cohort").when(i % 5 == 2, "trial").otherwise("other").alias("study_design"),
        F.when(i % 7 == 0, "").when(i % 7 == 1, "-3").when(i % 7 == 2, "12.0").otherwise("40").alias("sample_size"), F.lit("").alias("has_control"),
        F.when(i % 3 == 0, "true").when(i % 3 == 1, "FALSE").otherwise("maybe").alias("statistical_claim_present"), F.lit("null").alias("effect_direction"), F.lit("TRUE").alias("coi_disclosed_in_abstract"),
    )
    return labels.validated(cells).select("pmid", "reason", "sample_size")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT doc_id, sha1('Label the study.' || chr(10) || chr(10) || 'Abstract: ' || coalesce(text, '') || chr(10) || 'JSON:') AS digest FROM documents")
def q_prompt_build(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha1(text.prompt("Label the study.", F.col("text"))).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN length(replace(text, chr(10), ' ')) > 200 THEN substr(replace(text, chr(10), ' '), 1, 200) || '...' ELSE coalesce(replace(text, chr(10), ' '), '') END AS preview FROM conversations")
def q_preview(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", text.preview(F.col("text")).alias("preview"))


# State


_DIGEST = "SELECT event_type, CAST(ts AS DATE) AS day, sha256(array_to_string(list_sort(list_distinct(list(CAST(user_id AS VARCHAR)))), ',')) AS digest FROM events {w} GROUP BY 1, 2"


@query(f"WITH f AS ({_DIGEST.format(w='')}), k AS ({_DIGEST.format(w='WHERE event_id % 1000 <> 0')}) SELECT f.event_type, f.day, f.digest FROM f LEFT JOIN k USING (event_type, day) WHERE k.digest IS NULL OR k.digest <> f.digest")
def q_bucket_skip(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    keys = ["event_type", "day"]
    return tables.changed_buckets(tables.bucket_digest(e, keys, "user_id"), tables.bucket_digest(e.filter("event_id % 1000 <> 0"), keys, "user_id"), keys)


@query("SELECT user_id, event_type AS status, event_id AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q_manifest_upsert(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    cut = F.expr("at % 2 = 0")
    old = tables.upsert(e.limit(0), e.filter(cut), ["user_id"], "at")
    new = tables.upsert(e.limit(0), e.filter(~cut), ["user_id"], "at")
    newer = new.join(old.select("user_id", F.col("at").alias("was")), "user_id", "left").filter("was IS NULL OR at > was").drop("was")
    return tables.upsert(old, newer, ["user_id"])


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS pmid FROM customer ORDER BY pmid LIMIT 100")
def q_sorted_ids_limit(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("pmid")).orderBy("pmid").limit(100)


@query("SELECT * FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 3")
def q_top_values(spark, d):
    return reports.count_by(t(spark, d, "events"), "event_type").orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS row_id, CAST(floor((row_number() OVER (ORDER BY user_id) - 1) / 50) AS BIGINT) AS chunk FROM (SELECT DISTINCT user_id FROM events)")
def q_row_ids_in_chunks(spark, d):
    rows = tables.with_row_ids(t(spark, d, "events").select("user_id").distinct(), [F.col("user_id").asc()])
    return rows.select("user_id", F.col("row_id").cast("int").alias("row_id")).withColumn("chunk", F.floor(F.col("row_id") / 50))


# Extensions


@query("""WITH g AS (SELECT l_orderkey AS c, l_partkey AS r FROM lineitem UNION SELECT l_partkey, l_orderkey FROM lineitem),
b AS (SELECT r AS focal, c AS later, 1 AS f, 0 AS b FROM g UNION ALL SELECT DISTINCT p.c, q.c, 0, 1 FROM g p JOIN g q ON p.r = q.r AND p.c <> q.c), m AS (SELECT focal, later, max(f) AS f, max(b) AS b FROM b GROUP BY 1, 2)
SELECT focal, count(*) AS n, round(avg((-2 * f * b + f)::DOUBLE), 9) AS cd FROM m GROUP BY 1""")
def q_cd_index(spark, d):
    """Orders and parts of line items cite each other."""
    e = t(spark, d, "lineitem")
    edges = e.select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")).union(e.select("l_partkey", "l_orderkey"))
    return roadmap.cd_index(edges).withColumn("cd", F.round("cd", 9))


@query("SELECT a.vec_id, count(*) AS n_earlier, round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean_distance, round(min(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS min_distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id // 50 < a.vec_id // 50 GROUP BY 1")
def q_semantic_novelty(spark, d):
    v = t(spark, d, "embeddings").withColumn("year", F.floor(F.col("vec_id") / 50))
    n = roadmap.semantic_novelty(v, "vec_id", "label", "year")
    return n.select("vec_id", "n_earlier", F.round("mean_distance", 6).alias("mean_distance"), F.round("min_distance", 6).alias("min_distance"))


@query("WITH y AS (SELECT o_orderpriority AS journal, CAST(year(o_orderdate) AS INTEGER) AS year, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2) SELECT journal, year, n, round(avg(n) OVER (PARTITION BY journal ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 9) AS forecast FROM y")
def q_moving_average(spark, d):
    y = reports.trend(_papers(spark, d), "journal_slug").select(F.col("journal_slug").alias("journal"), "year", F.col("n").cast("double").alias("n"))
    return roadmap.moving_average(y, "journal", "year", "n").withColumn("forecast", F.round("forecast", 9))


# The queries of the other modules register themselves when these are imported.
from litmill.plans import entities, stores  # noqa: E402

__all__ = ["QUERIES", "SQL", "entities", "stores"]
