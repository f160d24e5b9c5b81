"""Registered queries of what is written and read back: tables, buckets, caches, manifests, failures, indexes and drivers.

Each writes to a folder of its own below the shared one and returns what it reads from there."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from litmill.functions.text import STOP_WORDS
from litmill.operators import index, labels, roadmap, topics, vectors
from litmill.plans import jobs
from litmill.plans.register import query, t
from litmill.schemas import conform
from litmill.session import shared_folder
from litmill.sources import drivers, tables, workbooks

STAMP = "2026-01-01T00:00:00+00:00"


# Tables


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents")
def q_union_by_name(spark, d):
    docs, root = t(spark, d, "documents"), shared_folder(spark, "union")
    docs.filter("doc_id % 2 = 0").select("doc_id", "lang").write.parquet(f"{root}/a")
    docs.filter("doc_id % 2 = 1").select("source", "doc_id").write.parquet(f"{root}/b")
    return tables.read(spark, f"{root}/*", ["doc_id", "lang", "source"])


@query("SELECT 0 AS missing, (SELECT count(*) FROM labels) AS held, 5 AS columns")
def q_optional_table(spark, d):
    root = shared_folder(spark, "optional")
    rows = t(spark, d, "labels").select(F.col("doc_id").alias("pmid"), F.lit("r").alias("rater"), F.lit("f").alias("field"), F.col("quality").cast("string").alias("value"), F.lit(STAMP).alias("imported_at"))
    tables.write_table(rows, root, "epistemic_handlabel")
    held = tables.read_optional(spark, f"{root}/epistemic_handlabel.parquet")
    missing = tables.read_optional(spark, f"{root}/staging.parquet", "staging")
    return held.agg(F.count(F.lit(1)).alias("held")).select(F.lit(missing.count()).alias("missing"), "held", F.lit(len(held.columns)).alias("columns"))


@query("""SELECT o_orderpriority AS journal_slug, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_new FROM orders
WHERE year(o_orderdate) <> 1997 OR o_orderkey % 2 = 0 GROUP BY 1, 2""")
def q_bucket_overwrite(spark, d):
    """Buckets of one year are written anew with other rows; the rest stays as it is."""
    root = shared_folder(spark, "buckets")
    papers = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.col("o_orderpriority").alias("journal_slug"), F.year("o_orderdate").alias("year"))
    tables.write_buckets(papers, root)
    tables.write_buckets(papers.filter("year = 1997 AND CAST(pmid AS BIGINT) % 2 = 0"), root)
    return tables.read(spark, root).groupBy("journal_slug", "year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pmid").cast("long") % 2 == 0).alias("n_new"))


@query("SELECT 'papers' AS name, 18 AS columns UNION ALL SELECT 'journals', 4 UNION ALL SELECT 'mesh', 4 UNION ALL SELECT 'citation_intents', 4")
def q_catalog(spark, d):
    root = shared_folder(spark, "catalog")
    papers = t(spark, d, "orders").limit(20).select(F.col("o_orderkey").cast("string").alias("pmid"), F.col("o_orderpriority").alias("journal_slug"), F.year("o_orderdate").alias("year"))
    tables.write_buckets(papers, f"{root}/papers")
    tables.write_table(papers.limit(0), root, "citation_intents")
    names = tables.register_corpus(spark, f"{root}/papers") + tables.register_enrichment(spark, root)
    known = tables.describe(spark)
    rows = [(n, len(known[n])) for n in names]
    for n in names:
        spark.catalog.dropTempView(n)
    return spark.createDataFrame(rows, "name string, columns int")


@query("SELECT r_regionkey, r_name AS name, CASE WHEN r_regionkey = 0 THEN 'none' ELSE 'kept' END AS state FROM region")
def q_manifest_json(spark, d):
    """Bucket manifests as JSON files; a missing and a broken one count as none."""
    root = shared_folder(spark, "manifests").removeprefix("file:")
    rows = []
    for r in t(spark, d, "region").collect():
        path = f"{root}/{r.r_regionkey}.json"
        if r.r_regionkey:
            tables.write_manifest(path, {"name": r.r_name})
        else:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text("{broken")
        body = tables.read_manifest(path)
        rows.append((r.r_regionkey, body["name"] if body else r.r_name, "kept" if body and body["fetched_at"] else "none"))
    return spark.createDataFrame(rows, "r_regionkey int, name string, state string")


@query("SELECT 'list' AS kind, 3 AS n UNION ALL SELECT 'blank', 0 UNION ALL SELECT 'other', -1 UNION ALL SELECT 'missing', -1")
def q_staging_list(spark, d):
    root = Path(shared_folder(spark, "staging").removeprefix("file:"))
    root.mkdir(parents=True)
    for name, body in (("list", "[1, 2, 3]"), ("blank", " \n"), ("other", '{"a": 1}')):
        (root / name).write_text(body)
    sizes = [(k, -1 if (x := tables.read_staging(str(root / k))) is None else len(x)) for k in ("list", "blank", "other", "missing")]
    return spark.createDataFrame(sizes, "kind string, n int")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def q_json_cache(spark, d):
    """Documents cached as text; broken ones come back as null."""
    path = shared_folder(spark, "cache")
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    tables.write_cache(t(spark, d, "events").select(F.col("event_id").cast("string").alias("pmid"), broken.alias("raw_json")), path)
    return tables.read_cache(spark, path, "k long").select(F.col("pmid").cast("long").alias("event_id"), F.col("document.k").alias("k"))


@query("SELECT n_name AS raw_string, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS match_score FROM nation")
def q_cache_flush(spark, d):
    """Answers are added to a lookup cache; a newer one replaces an older of its key, and blank keys aren't read."""
    path = f"{shared_folder(spark, 'lookups')}/cache.parquet"
    rows = t(spark, d, "nation").select(F.col("n_name").alias("raw_string"), F.lit(0.5).alias("match_score"), "n_nationkey")
    blank = spark.createDataFrame([("", 0.9)], "raw_string string, match_score double")
    tables.flush_cache(spark, path, conform(rows.unionByName(blank, allowMissingColumns=True), "affiliation_cache"), ["raw_string"])
    tables.flush_cache(spark, path, conform(rows.filter("n_nationkey % 2 = 0").withColumn("match_score", F.lit(1.0)), "affiliation_cache"), ["raw_string"])
    return tables.affiliation_cache(spark, path).select("raw_string", "match_score")


@query("SELECT doc_id, CAST(least(length(text), 2000) AS INTEGER) AS kept FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL AND length(text) > 0")
def q_failures_jsonl(spark, d):
    root = shared_folder(spark, "failures")
    rows = t(spark, d, "documents").filter("doc_id % 7 = 0 AND text IS NOT NULL AND length(text) > 0").select(F.col("text").alias("raw_xml"), F.col("doc_id").cast("string").alias("error"))
    if tables.write_failures(rows.limit(0), f"{root}/none") or not tables.write_failures(rows, f"{root}/some"):
        raise AssertionError("an empty table of failures must leave no file")
    back = spark.read.schema("error string, raw_xml string").json(f"{root}/some")
    return back.select(F.col("error").cast("long").alias("doc_id"), F.length("raw_xml").alias("kept"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS pmid, n_name AS title FROM nation")
def q_csv_round_trip(spark, d):
    path = shared_folder(spark, "csv")
    tables.write_csv(t(spark, d, "nation").select(F.col("n_nationkey").alias("pmid"), F.col("n_name").alias("title")), path)
    return tables.read_labels_csv(spark, path, ["pmid", "title"])


@query("""SELECT sha256('{"a": 1, "b": "x"}') AS config_sha256, '{"a": 1, "b": "x"}' AS config, 1 AS inputs""")
def q_provenance(spark, d):
    root = Path(shared_folder(spark, "run").removeprefix("file:"))
    root.mkdir(parents=True)
    body = json.loads(Path(tables.record_run(str(root / "artifact"), [f"{d}/region.parquet"], {"b": "x", "a": 1}, spark)).read_text())
    row = (body["config_sha256"], json.dumps(body["config"], sort_keys=True), len([x for x in body["inputs"].values() if x or d.startswith("viewfs")]))
    return spark.createDataFrame([row], "config_sha256 string, config string, inputs int")


# Drivers of services


class Parts:
    """A client whose batches with an id that ends in 7 fail, as does that id; every tenth is unknown and one is no JSON."""

    def lookup(self, ids):
        if any(i.endswith("7") for i in ids):
            raise OSError("refused")
        return {i: "{" if i.endswith("13") else json.dumps({"id": f"W{i}"}) for i in ids if not i.endswith("0")}


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pmid, CASE WHEN p_partkey % 10 = 7 THEN 'error' WHEN p_partkey % 10 = 0 THEN 'missing' WHEN p_partkey % 100 = 13 THEN 'error' ELSE 'ok' END AS status,
CASE WHEN p_partkey % 10 IN (0, 7) OR p_partkey % 100 = 13 THEN NULL ELSE 'W' || p_partkey END AS openalex_id FROM part WHERE p_partkey <= 500""")
def q_driver_manifest(spark, d):
    """A first run, and a second that asks only for what wasn't fetched."""
    root = shared_folder(spark, "driver")
    ids = t(spark, d, "part").filter("p_partkey <= 500").select(F.col("p_partkey").cast("string").alias("pmid"))
    how = {"size": 20, "attempts": 1, "at": STAMP}
    first = drivers.drive(spark, root, "works", ids, Parts, **how)
    again = drivers.drive(spark, root, "works", ids, Parts, **how)
    if again["asked"] != first["failed"]:
        raise AssertionError("fetched ids were asked for again")
    return tables.read_optional(spark, f"{root}/works_manifest.parquet").select("pmid", "status", "openalex_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid, CASE WHEN p_partkey % 10 = 7 THEN 'OSError: refused' WHEN p_partkey % 10 = 0 THEN 'not found' ELSE 'not a JSON object' END AS reason FROM part WHERE p_partkey <= 500 AND (p_partkey % 10 IN (0, 7) OR p_partkey % 100 = 13)")
def q_driver_failures(spark, d):
    root = shared_folder(spark, "driver")
    ids = t(spark, d, "part").filter("p_partkey <= 500").select(F.col("p_partkey").cast("string").alias("pmid"))
    drivers.drive(spark, root, "works", ids, Parts, size=20, attempts=1, at=STAMP)
    return tables.read_optional(spark, f"{root}/works_failed.parquet").select("pmid", "reason")


@query("SELECT (SELECT count(*) FROM part WHERE p_partkey <= 500 AND NOT (p_partkey % 10 IN (0, 7) OR p_partkey % 100 = 13)) AS openalex_works, 0::BIGINT AS semantic_scholar, 0::BIGINT AS papers_asked, (SELECT count(*) FROM part WHERE p_partkey <= 500 AND (p_partkey % 10 IN (0, 7) OR p_partkey % 100 = 13)) AS enrichment_failed")
def q_enrich_from_services(spark, d):
    """Both sources side by side, the second without its key."""
    ids = t(spark, d, "part").filter("p_partkey <= 500").select(F.col("p_partkey").cast("string").alias("pmid"))
    counts = jobs.enrich_from_services(spark, shared_folder(spark, "services"), ids, {"works": Parts, "papers": Parts}, size=20, attempts=1, at=STAMP)
    names = ("openalex_works", "semantic_scholar", "papers_asked", "enrichment_failed")
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


class Matcher:
    """A client of affiliation lookups: nations by name with a score of their length."""

    def match(self, text):
        if text.startswith("NATION_1"):
            raise OSError("refused")
        return json.dumps({"items": [{"organization": {"id": f"R{text}", "name": text, "country": {"country_code": "XX"}, "types": ["x"]}, "score": 0.9 if text.endswith(("2", "4")) else 0.5}]})


@query("""SELECT n_name AS raw_string, CASE WHEN n_nationkey = 1 THEN 'kept' WHEN n_name LIKE '%2' OR n_name LIKE '%4' THEN 'R' || n_name ELSE '' END AS ror_id, CASE WHEN n_nationkey = 1 THEN 1.0 WHEN n_name LIKE '%2' OR n_name LIKE '%4' THEN 0.9 ELSE 0.5 END::DOUBLE AS match_score
FROM nation WHERE n_name NOT LIKE 'NATION_1%' OR n_nationkey = 1""")
def q_affiliation_lookup(spark, d):
    """A cache that holds one nation is asked to hold all; what fails is left out."""
    path, nations = f"{shared_folder(spark, 'affiliations')}/cache.parquet", t(spark, d, "nation")
    held = nations.filter("n_nationkey = 1").select(F.col("n_name").alias("raw_string"), F.lit("kept").alias("ror_id"), F.lit(1.0).alias("match_score"))
    tables.flush_cache(spark, path, conform(held, "affiliation_cache"), ["raw_string"])
    rows = drivers.affiliations(spark, path, nations.select(F.col("n_name").alias("raw_string")), Matcher, attempts=1, at=STAMP)
    return rows.select("raw_string", "ror_id", "match_score")


@query("SELECT doc_id AS pmid, 'r1' AS rater, coalesce(lang, '') || ' <&> ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'other' END AS study_design FROM documents WHERE doc_id % 3 = 0")
def q_label_workbook(spark, d):
    """A sheet as a workbook, read back."""
    i = F.col("doc_id")
    sample = t(spark, d, "documents").filter("doc_id % 3 = 0").select(i.alias("pmid"), F.concat(F.coalesce("lang", F.lit("")), F.lit(" <&> "), i.cast("string")).alias("title"), F.lit("a").alias("abstract"))
    sheet = labels.sheet(sample, "r1").withColumn("study_design", F.when(F.col("pmid") % 2 == 0, "other").otherwise(""))
    root = Path(shared_folder(spark, "workbook").removeprefix("file:"))
    root.mkdir(parents=True)
    workbooks.write_sheet(sheet, str(root / "sheet.xlsx"))
    return workbooks.read_sheet(spark, str(root / "sheet.xlsx")).select(F.col("pmid").cast("long").alias("pmid"), "rater", "title", "study_design")


# Harvest


@query("""SELECT s_nationkey AS bucket, count(*) AS n FROM supplier GROUP BY 1""")
def q_harvest_buckets(spark, d):
    """One article in two journals' buckets is a row in each."""
    s = t(spark, d, "supplier")
    pmid = F.col("s_suppkey").cast("string")
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), pmid, F.lit("</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>"))
    of = F.explode(F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("all")))
    sets = s.select(of.alias("journal_slug"), F.lit(2001).alias("year"), pmid.alias("pmid"), xml.alias("xml")).groupBy("journal_slug", "year").agg(F.collect_list("pmid").alias("pmids"), F.concat_ws("", F.collect_list("xml")).alias("xml"))
    sets = sets.select("journal_slug", "year", "pmids", F.transform("pmids", lambda p: F.col("journal_slug")).alias("terms"), F.concat(F.lit("<PubmedArticleSet>"), "xml", F.lit("</PubmedArticleSet>")).alias("xml"))
    root = shared_folder(spark, "harvest")
    jobs.harvest(sets, root, fetched_at=STAMP)
    papers = tables.read(spark, f"{root}/papers").filter("journal_slug <> 'all' AND source_ta_match = journal_slug")
    return papers.groupBy(F.substring("journal_slug", 2, 9).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Index, encoders and jobs


@query("SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def q_ann_recall(spark, d):
    """Recall at 10 of the index against exact search, 0.9 at least."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), "embedding")
    path, queries = f"{shared_folder(spark, 'index')}/index", v.filter("pmid % 50 = 0")
    index.save(index.build(v, m=16, ef_construction=100), path)
    found = index.search(index.load(spark, path), queries, 10, ef=96)
    hits = vectors.nearest(v, queries, 10).select("query", "neighbour").join(found, ["query", "neighbour"], "left_semi").count()
    n = queries.count()
    return spark.createDataFrame([(n, hits >= 0.9 * 10 * n)], "n_queries long, recall_reached boolean")


@query("SELECT vec_id AS pmid, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS same, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id FROM embeddings QUALIFY vec_id % 10 = 3")
def q_vector_lookup(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), "embedding")
    root = shared_folder(spark, "rows")
    tables.save_index(v, root)
    held = index.build(v, m=4, ef_construction=8)
    from litmill.functions.arrays import cosine

    wanted = v.filter("pmid % 10 = 3")
    rows = index.lookup(held, wanted).withColumnRenamed("embedding", "held").join(wanted, "pmid").select("pmid", F.round(cosine(F.col("held"), F.col("embedding")), 6).alias("same"))
    return rows.join(spark.read.parquet(root).select("pmid", F.col("row_id").cast("long").alias("row_id")), "pmid")


@query("SELECT doc_id AS pmid, 'nomic' AS model_name, 768 AS dim, CASE WHEN length(trim(text)) > 0 THEN true END AS unit FROM documents WHERE text IS NOT NULL AND length(text) > 50")
def q_embed_job(spark, d):
    papers = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    papers = papers.withColumn("nth", F.row_number().over(_first_by("pmid"))).filter("nth = 1").drop("nth")
    from litmill.functions.arrays import norm

    rows = jobs.embed(papers, "nomic")
    return rows.select("pmid", "model_name", F.size("embedding").alias("dim"), F.when(F.abs(norm(F.col("embedding")) - 1) < 1e-3, True).alias("unit"))


def _first_by(key: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(F.length("abstract").desc_nulls_last())


@query("SELECT CAST(label AS BIGINT) AS topic_id, count(*) AS n FROM embeddings GROUP BY 1")
def q_assignment_rows(spark, d):
    """Assignments written and read back have a row for each vector."""
    v = t(spark, d, "embeddings")
    root = shared_folder(spark, "topics")
    tables.write_table(v.select(F.col("vec_id").alias("pmid"), F.col("label").cast("long").alias("topic_id"), F.lit(False).alias("is_noise")), root, "topics")
    return spark.read.parquet(f"{root}/topics.parquet").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS assigned, CAST(count(DISTINCT label) AS INTEGER) AS topics, true AS same_config FROM embeddings")
def q_topic_model_saved(spark, d):
    """A saved model assigns a topic to every vector it was made of, as each lies within reach of its own."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), F.col("label").cast("long").alias("topic_id"), "embedding")
    path = shared_folder(spark, "model")
    words = v.select("topic_id").distinct().select("topic_id", F.array(F.lit("w")).alias("words"))
    topics.save_model(path, v.select("pmid", "topic_id"), v.select("pmid", "embedding"), words, topics.TopicConfig())
    config, model = topics.load_model(spark, path)
    found = topics.apply_model(v.select("pmid", "embedding"), model)
    kept = found.agg(F.count(F.lit(1)).alias("assigned"))
    return kept.select("assigned", F.lit(model.count()).alias("topics"), F.lit(config == topics.TopicConfig()).alias("same_config"))


_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


@query(f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN {_STOP}) AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT list_sort(list_filter(['de', 'der', 'el', 'la', 'que', 'und'], lambda x: list_contains(w[i:i + 9], x))) AS terms FROM p) SELECT array_to_string(terms, ' ') AS terms, count(*) AS n FROM s GROUP BY 1""")
def q_window_terms(spark, d):
    """Which of six words occur in which windows of ten tokens."""
    found = topics._windows(t(spark, d, "documents"), ["de", "der", "el", "la", "que", "und"], 10, "doc_id", "text")
    return found.groupBy(F.array_join("terms", " ").alias("terms")).agg(F.sum("n").alias("n"))


# Sampling and extensions


@query("SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 50 GROUP BY 1")
def q_sampling_pool(spark, d):
    papers = t(spark, d, "documents").select(F.col("doc_id").alias("pmid"), F.col("source").alias("journal_slug"), F.lit(2004).alias("year"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    return labels.pool(papers).groupBy(F.col("journal").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS k, CASE WHEN 2010 + n_nationkey <= 2017 THEN 'train' WHEN 2010 + n_nationkey <= 2020 THEN 'validation' ELSE 'test' END AS split FROM nation")
def q_temporal_split(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), roadmap.temporal_split(F.lit(2010) + F.col("n_nationkey")).alias("split"))


@query("""WITH m AS (SELECT quantile_cont(p_size, 0.5) AS a, quantile_cont(p_retailprice, 0.5) AS b FROM part) SELECT CASE WHEN p_size > a AND p_retailprice > b THEN 'frontier' WHEN p_size > a THEN 'isolated' WHEN p_retailprice > b THEN 'repackaging' ELSE 'consolidation' END AS archetype, count(*) AS n FROM part, m GROUP BY 1""")
def q_archetypes(spark, d):
    return roadmap.archetypes(t(spark, d, "part"), "p_size", "p_retailprice").groupBy("archetype").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT o_orderpriority AS journal, CAST(year(o_orderdate) AS INTEGER) AS year, count(*)::DOUBLE AS n, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS m FROM orders GROUP BY 1, 2),
l AS (SELECT journal, k AS lag, n AS x, lead(m, k) OVER (PARTITION BY journal, k ORDER BY year) AS y FROM y, range(0, 3) AS r(k)) SELECT journal, CAST(lag AS INTEGER) AS lag, round(corr(x, y), 6) AS correlation FROM l WHERE y IS NOT NULL GROUP BY 1, 2""")
def q_lead_lag(spark, d):
    y = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("journal"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col("o_orderkey") % 3 == 0, 1.0).otherwise(0.0)).alias("m"))
    return roadmap.lead_lag(y, "journal", "year", "n", "m", 2).withColumn("correlation", F.round("correlation", 6))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 8) AS rho FROM r")
def q_spearman(spark, d):
    return roadmap.spearman(t(spark, d, "lineitem"), "l_quantity", "l_discount").select(F.round("rho", 8).alias("rho"))
