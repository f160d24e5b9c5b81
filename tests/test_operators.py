import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.operators import agreement, dedup, labels, reports, resolve, roadmap, topics, vectors
from litmill.schemas import empty, schema
from litmill.streaming import events as streams


def test_distinct_papers(spark):
    rows = [("1", "t", "short", "b"), ("1", "t", "longer abstract", "a"), ("2", "t", None, "a"), ("3", "t", "same", "a"), ("3", "u", "same", "b")]
    df = spark.createDataFrame(rows, "pmid string, title string, abstract string, fetched_at string")
    got = {r.pmid: r for r in dedup.distinct_papers(df).collect()}
    assert len(got) == 3 and got["1"].abstract == "longer abstract" and got["3"].fetched_at == "b"
    assert tuple(dedup.integrity(df, ["pmid"]).first()) == (5, 3, 2)
    with pytest.raises(ValueError):
        dedup.require_unique(df, "pmid")
    assert dedup.drifted(20_000) and not dedup.drifted(13_000)


def test_distinct_vectors(spark):
    v = lambda i, o, x: (i, o, [x, 1.0])
    df = spark.createDataFrame([v(1, 0, 0.5), v(1, 1, 0.5001), v(2, 2, 0.1)], "pmid long, ordinal int, embedding array<float>")
    assert dedup.distinct_vectors(df).count() == 2
    with pytest.raises(ValueError, match="divergent duplicate embeddings"):
        dedup.distinct_vectors(df.union(spark.createDataFrame([v(2, 9, 0.6)], df.schema)))
    with pytest.raises(ValueError):
        dedup.require_known(df, df.filter("pmid = 1"))
    assert dedup.same_ids(df, df.limit(3)) and not dedup.same_ids(df, df.filter("pmid = 1"))


def test_quartiles_and_matrix(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "id int, v double")
    assert [r.quartile for r in reports.quartiles(df, "v").orderBy("id").collect()] == [1, 1, 2, 2, 3, 3, 4, 4]
    with pytest.raises(ValueError):
        reports.quartiles(df.withColumn("v", F.lit(1.0)), "v")
    assert reports.overall_rate(df, F.col("v") > 100, F.lit(True)) is None


def test_nearest(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 16))
    rows = [(i * 25 + j, (centres[i] + 0.05 * rng.normal(size=16)).tolist(), i) for i in range(4) for j in range(25)]
    df = spark.createDataFrame(rows, "pmid long, embedding array<double>, label int")
    block, vectors.BLOCK = vectors.BLOCK, 30
    try:
        found = vectors.nearest(df, df, 10).cache()
    finally:
        vectors.BLOCK = block
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(100) for j in np.argsort(-s[i], kind="stable")[:10]}
    assert {(r.query, r.neighbour) for r in found.collect()} == want
    assert vectors.label_precision(found, df).first().precision == 1.0
    assert vectors.separation(df).first().separation > 0.5


def test_encoders(spark):
    with pytest.raises(ValueError, match="mpnet"):
        vectors.make_encoder("none")
    got = vectors.embed(spark.createDataFrame([(1, "knee pain"), (2, None), (3, "knee pain")], "pmid long, text string")).orderBy("pmid").collect()
    assert got[0].embedding == got[2].embedding and abs(sum(x * x for x in got[0].embedding) - 1) < 1e-5 and len(got[1].embedding) == 768
    scores = lambda *rows: spark.createDataFrame(list(rows), "model string, score double")
    assert vectors.choose_model(scores(("a", 0.2), ("b", 0.22)), "a").first().model == "a"
    assert vectors.choose_model(scores(("a", 0.2), ("b", 0.24)), "a").first().model == "b"
    assert vectors.choose_model(scores(("b", 0.24)), "a").first().reason == "no baseline"


def test_agreement(spark):
    a = ["x"] * 5 + ["y"] * 5
    b = ["x"] * 4 + ["y"] + ["x"] + ["y"] * 4
    assert agreement.kappa(a, b, spark) == pytest.approx(0.6)
    assert agreement.kappa(["x", "y"], ["y", "x"], spark) == pytest.approx(-1)
    assert math.isnan(agreement.kappa(["x", "x"], ["x", "x"], spark)) and math.isnan(agreement.kappa([None, "x"], ["x", "y"], spark))
    assert agreement.alpha(a, b, spark) == pytest.approx(1 - 19 * 4 / (400 - 200))
    with pytest.raises(ValueError):
        agreement.kappa(["x"], [], spark)
    assert agreement.concordance(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, None)], "x double, y double"), "x", "y").first().ccc == pytest.approx(1)


def test_allocation():
    rng = random.Random(1)
    for _ in range(300):
        counts = [rng.randint(0, 30) for _ in range(rng.randint(1, 12))]
        n = rng.randint(0, 60)
        seats = labels.allocate(counts, n)
        assert sum(seats) == min(n, sum(counts)) and all(0 <= s <= c for s, c in zip(seats, counts, strict=True))
    assert labels.allocate([0, 0], 5) == [0, 0] and labels.allocate([10, 10, 10], 10) == [4, 3, 3]


def _pool(spark):
    rows = [(str(j * 1000 + e * 100 + i), f"j{j}", f"t{i}", "x" * 60, [1990, 2005, 2015, 2022][e]) for j in range(3) for e in range(4) for i in range(50)]
    return spark.createDataFrame(rows, "pmid string, journal_slug string, title string, abstract string, year int")


def test_stratified(spark):
    papers = _pool(spark)
    known = papers.filter("cast(pmid as long) % 17 <> 0").select(F.col("pmid").cast("long").alias("pmid"), (F.col("pmid").cast("long") % 90).alias("topic_id"))
    a = [r.pmid for r in labels.stratified(papers, known, 120, least_topics=40).collect()]
    b = [r.pmid for r in labels.stratified(papers.repartition(7), known, 120, least_topics=40).collect()]
    c = [r.pmid for r in labels.stratified(papers, known, 120, seed=1, least_topics=40).collect()]
    assert len(a) == 120 and a == b and a != c and a == sorted(a)
    with pytest.raises(ValueError, match="topics"):
        labels.stratified(papers, known, 120, least_topics=500)
    with pytest.raises(ValueError):
        labels.stratified(papers.limit(0), known, 10)


def test_label_import(spark):
    cell = lambda pmid, rater, design="RCT", size="", claim="TRUE": (pmid, rater, design, size, "", claim, "null", "FALSE")
    kinds = "pmid long, rater string, " + ", ".join(f"{f} string" for f in labels.FIELDS)
    rows = [cell(1, "a"), cell(2, "a", "bad"), cell(3, "a", size="0"), cell(4, "a", claim="maybe"), (5, "a", "", "", " ", "", "", "")]
    table, errors, summary = labels.import_sheet(spark.createDataFrame(rows, kinds), empty(spark, "epistemic_handlabel"), "now")
    assert summary == {"n_rows": 5, "n_imported": 1, "n_errors": 3}
    assert {(r.pmid, r.reason) for r in errors.collect()} == {(2, "study_design"), (3, "sample_size"), (4, "statistical_claim_present")}
    assert {(r.field, r.value) for r in table.collect()} >= {("effect_direction", "null"), ("sample_size", None), ("statistical_claim_present", "true")}
    again, _, _ = labels.import_sheet(spark.createDataFrame([cell(1, "a", "cohort"), cell(1, "b")], kinds), table, "later")
    assert again.count() == 12 and again.filter("rater = 'a' AND field = 'study_design'").first().value == "cohort"
    assert agreement.summary(agreement.raters(again, "a", "b")).count() == 4  # size and control are null for both


def test_extraction(spark):
    def failing(prompt: str) -> str:
        if "boom" in prompt:
            raise RuntimeError("no answer")
        if "fenced" in prompt:
            return "```json\n" + labels.rule_model(prompt) + "\n```"
        return labels.rule_model(prompt) if "one JSON object" in prompt else "not JSON"

    rows = spark.createDataFrame([(3, "Abstract: randomised 40 patients improved\nJSON:"), (1, "Abstract: fenced\nJSON:"), (2, "Abstract: boom\nJSON:")], "pmid long, prompt string")
    good, bad = labels.pilot(rows, 10, model=failing, at="now")
    got = {r.pmid: r for r in good.collect()}
    assert set(got) == {1, 3} and got[3].sample_size == 40 and got[3].study_design == "RCT" and [r.pmid for r in bad.collect()] == [2]
    assert labels.pilot(rows, 0)[0].count() == 0
    names = lambda s: [f.name for f in s.fields]
    assert names(good.schema) == names(schema("epistemic_pilot")) and names(bad.schema) == names(schema("epistemic_pilot_failed"))


def test_rarest(spark):
    pairs = spark.createDataFrame([(i, f"m{j}") for j in range(6) for i in range(60) if i % (j + 1) == 0], "pmid long, mesh string")
    k, chosen = labels.rarest_labels(pairs, rows=5, least=2)
    assert k >= 2 and chosen.count() == chosen.select("pmid").distinct().count()
    with pytest.raises(ValueError):
        labels.rarest_labels(pairs, rows=1000)


def test_rarest_of_sets(spark):
    """Rows of one key count once; nothing but counts is shuffled, and nothing at all for the choice."""
    rows = [(1, "aa bb bb cc"), (1, "aa dd"), (2, "aa bb"), (3, "bb aa"), (4, None), (5, "zz"), (None, "cc aa"), (None, "bb"), (6, "ee aa dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = labels.merged_sets(docs, topics.term_list("text", stop_words=[]), "doc_id", "terms")
    k, chosen = labels.rarest_of_sets(sets, F.col("terms"), "doc_id", "term", most=4, least=1, rows_each=0)
    assert k == 4 and {(r.doc_id, r.term) for r in chosen.collect()} == {(1, "cc"), (2, "bb"), (3, "bb"), (None, "cc"), (6, "dd")}
    alone = docs.filter("doc_id > 1")
    chosen = labels.rarest_of_sets(labels.merged_sets(alone, topics.term_list("text", stop_words=[]), "doc_id", "terms"), F.col("terms"), "doc_id", "term", least=1, rows_each=0)[1]
    assert "Exchange" not in chosen._jdf.queryExecution().executedPlan().toString() and chosen.count() == 4


def test_authors(spark):
    inst = lambda oa, cc: (oa, "", "n", cc, "t")
    rows = [
        ("1", 0, "first", "", "0-1", "A", [], []), ("1", 1, "", "A2", "", "B", [], []), ("1", 2, "LAST", "", "", "Ann Müller", [inst("I1", "DE"), inst("I2", "DE")], []),
        ("2", 0, "", "", "", "A. Muller", [inst("I2", "FR")], []), ("2", 5, "", "", "", "Zed Zorn", [inst("", "US")], []),
    ]
    got = {(r.pmid, r.author_position): r for r in resolve.authors(spark.createDataFrame(rows, schema("staging"))).collect()}
    assert got["1", 0].author_canonical_id == "ORCID:0-1" and got["1", 1].author_canonical_id == "OA:A2" and got["1", 1].disambiguation_method == "openalex"
    assert got["1", 2].author_canonical_id == got["2", 0].author_canonical_id and got["1", 2].author_canonical_id.startswith("H:H")
    assert got["1", 0].is_first and got["1", 2].is_last and not got["1", 1].is_first and got["2", 5].is_last and got["2", 0].is_first


def test_position_flags_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "TASK_ROWS", 100)
    rows = spark.range(5000).selectExpr("CAST(id % 900 AS STRING) AS pmid", "CAST(id % 7 AS INT) AS author_position", "'' AS author_position_label")
    flags = resolve.position_flags(rows)
    sizes = [r["count"] for r in flags.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 300 and sum(sizes) == 5000
    ends = rows.groupBy("pmid").agg(F.min("author_position").alias("lo"), F.max("author_position").alias("hi"))
    assert flags.join(ends, "pmid").filter("is_first <> (author_position = lo) OR is_last <> (author_position = hi)").count() == 0


def test_authors_of_one_name(spark, monkeypatch):
    """Rows of one name are not gathered in one task, however many names there are."""
    rows = [(str(i), i % 3, "", "" if i % 2 else f"A{i}", "", "Jane Doe", [(f"I{i % 5 % 4}", "", "n", "DE", "t")], []) for i in range(400)]
    staging = spark.createDataFrame(rows, schema("staging"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = resolve.authors(staging)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        few = sorted(map(tuple, found.collect()))
        monkeypatch.setattr(resolve, "BROADCAST_NAMES", 0)
        found = resolve.authors(staging)
        largest = found.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert sorted(map(tuple, found.collect())) == few and largest < 150
    finally:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "10m"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "4")):
            spark.conf.set(k, v)


def test_institutions(spark):
    inst = lambda oa, ror, name: (oa, ror, name, "DE", "edu")
    rows = [("1", 0, "", "", "", "A", [inst("I1", "r1", "One"), inst("", "r2", "Two"), inst("", "", "Three"), inst("", "", "")], []), ("1", 1, "", "", "", "B", [], [" Clinic X ", "Y"]), ("2", 0, "", "", "", "C", [inst("I1", "", "Uno")], []), ("3", 0, "", "", "", "D", [], ["Unknown"])]
    cache = spark.createDataFrame([("Clinic X", "https://ror.org/9", "Clinic", "DE", "health", 0.9, "now"), ("Unknown", "https://ror.org/8", "U", "DE", "x", 0.5, "now")], schema("affiliation_cache"))
    table, links = resolve.institutions(spark.createDataFrame(rows, schema("staging")), cache)
    got = {r.institution_canonical_id: r for r in table.collect()}
    assert got["OA:I1"].display_name == "One" and got["ROR:r2"].display_name == "Two" and "ROR:https://ror.org/9" in got and len(got) == 5
    assert {r.ror_matched_by for r in links.collect()} == {"openalex", "unmatched", "ror_api"} and links.count() == 6


def _planted(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 64))
    words = [[f"w{k}{c}x" for c in "abcde"] for k in range(5)]
    rows = [(k * 100 + i, (centres[k] + 0.05 * rng.normal(size=64)).tolist(), " ".join(rng.choice(words[k], 12))) for k in range(5) for i in range(100)]
    return spark.createDataFrame(rows, "pmid long, embedding array<double>, text string")


def test_topics(spark):
    df = _planted(spark)
    config = topics.TopicConfig(min_cluster_size=30, min_samples=10, min_df=2, ngram=1, mid_target=3, top_target=2)
    assigned = topics.fit(df, config).cache()
    sizes = {r.topic_id: r["count"] for r in assigned.filter("NOT is_noise").groupBy("topic_id").count().collect()}
    assert len(sizes) >= 4 and assigned.count() == 500
    docs = df.select("pmid", "text").join(assigned.filter("NOT is_noise"), "pmid")
    words = topics.word_lists(topics.top_words(topics.class_weights(docs)))
    tree = topics.hierarchy(assigned, df, words, config).collect()
    assert len({r.mid_level_id for r in tree}) == 3 and len({r.top_level_id for r in tree}) == 2 and all(len(r.representative_docs) == 3 and r.top_words for r in tree)
    swept = topics.sweep(df, df.select("pmid", "text"), [config, topics.TopicConfig(n_components="bad")])
    rows = swept.collect()
    assert rows[0].error is None and rows[0].npmi_top10 is not None and rows[1].error and topics.choose(swept).first().constraints_unmet
    assert topics.near_misses(swept).count() == 1


def test_coherence(spark):
    docs = spark.createDataFrame([(i, ("knee joint surgery repair" if i % 2 else "bank money loan credit") + f" filler{i}") for i in range(30)], "pmid long, text string")
    good, bad = [["knee", "joint", "surgery"]], [["knee", "money", "joint"]]
    for metric in ("c_npmi", "c_v"):
        assert topics.coherence(good, docs, metric=metric) > topics.coherence(bad, docs, metric=metric)
    assert math.isnan(topics.coherence([[], [" "]], docs))


def test_cut():
    merges = [(0.1, [0], [1]), (0.2, [2], [3]), (0.3, [0, 1], [2, 3]), (0.4, [4], [0, 1, 2, 3])]
    assert topics.cut([0, 1, 2, 3, 4], merges, 3) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    assert len(set(topics.cut([0, 1, 2, 3, 4], merges, 1).values())) == 1 and len(set(topics.cut([0, 1, 2, 3, 4], merges, 1, leaf_only=True).values())) == 3


def test_roadmap(spark):
    e = spark.createDataFrame([("f", "r1"), ("a", "f"), ("b", "f"), ("b", "r1"), ("c", "r1")], "citing string, cited string")
    assert roadmap.cd_index(e).filter("focal = 'f'").first().cd == pytest.approx((1 - 1 + 0) / 3)
    s = spark.createDataFrame([("t", y, float(y), float(y - 1)) for y in range(10)], "g string, y int, a double, b double")
    assert roadmap.lead_lag(s, "g", "y", "a", "b").filter("lag = 1").first().correlation == pytest.approx(1)
    assert roadmap.spearman(s, "a", "b").first().rho == pytest.approx(1)
    assert roadmap.archetypes(s, "a", "b").select("archetype").distinct().count() == 2


def test_nearest_with_copies_and_gaps(spark, monkeypatch):
    """Against all pairs: equal vectors, zero vectors and one with a missing component, in blocks, stripes and tiles."""
    monkeypatch.setattr(vectors, "LEAST", 30)
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "STRIPE", 7)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 8)).round(2)
    v[20:60] = v[20]
    v[70] = 0
    rows = [(i, x.tolist() if i != 80 else [None, *x[1:].tolist()]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "pmid long, embedding array<float>")
    u = np.array([[np.nan if y is None else np.float32(y) for y in x] for _, x in rows], np.float64)
    with np.errstate(invalid="ignore"):
        u = np.where((length := np.linalg.norm(u, axis=1, keepdims=True)) == 0, 0, u / length)
    s = np.round(u @ u.T, 9)
    want = {(i, j, r) for i in range(120) for r, j in enumerate(sorted((j for j in range(120) if j != i and s[i, j] > -9), key=lambda j: (-s[i, j], j))[:10], 1)}
    assert {(r.query, r.neighbour, r.rank) for r in vectors.nearest(df, df).collect()} == want


def test_nearest_sorts_few_candidates(monkeypatch):
    """All pairs are multiplied, but only those that may be among the best are rounded and sorted."""
    a, seen, first = np.random.default_rng(6).normal(size=(3000, 64)), [], vectors._first
    monkeypatch.setattr(vectors, "TILE", 500)
    monkeypatch.setattr(vectors, "_first", lambda k, row, *x: (seen.append(len(row)), first(k, row, *x))[1])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    row, col, _ = vectors._best(a, a, np.arange(3000), 10)
    s = np.round(a @ a.T, 9)
    np.fill_diagonal(s, -np.inf)
    assert (col.reshape(3000, 10) == np.argsort(-s, axis=1, kind="stable")[:, :10]).all() and sum(seen) < 3000 * 3000 // 20


def test_cd_index_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(roadmap, "BLOCK_EDGES", 60)
    monkeypatch.setattr(roadmap, "PART_EDGES", 50)
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 400), rng.zipf(1.4, 400) % 60, strict=True)] + [(None, 3), (None, 3), (5, None), (2**62, -(2**62)), (7, -(2**62)), (7, 7)]
    known = {(a, b) for a, b in pairs if a is not None and b is not None}
    citers, want = {}, {}
    for a, b in known:
        citers.setdefault(b, set()).add(a)
    for x in {a for a, _ in known} | set(citers) | {None}:
        f = set(citers.get(x, ())) | {a for a, b in pairs if b == x and (a is None or b is None)}
        through = {y for a, b in known if a == x for y in citers[b]} - {x}
        if f | through:
            want[x] = (len(f | through), round((len(f) - 2 * len(f & through)) / len(f | through), 9))
    for kind, of in (("long", lambda x: x), ("string", lambda x: x if x is None else f"w{x}")):
        df = spark.createDataFrame([(of(a), of(b)) for a, b in pairs], f"citing {kind}, cited {kind}")
        assert {r.focal: (r.n, round(r.cd, 9)) for r in roadmap.cd_index(df).collect()} == {of(x): v for x, v in want.items()}


def test_cd_index_in_portions(monkeypatch):
    """Lists of one block compared a few pairs at a time give the same; a pair of works is never a row that is shuffled."""
    c, r = np.repeat(np.arange(40), 5), np.tile(np.arange(5), 40)
    batch = pa.RecordBatch.from_arrays([pa.array(c), pa.array(r)], ["c", "r"])
    whole = []
    for most in (4_000_000, 7):
        monkeypatch.setattr(roadmap, "PAIRS_AT_ONCE", most)
        tables = [pa.Table.from_batches([b]) for b in roadmap._citers_by_block(iter([batch]), np.array([10, 20, 30]))]
        assert sum(t.nbytes for t in tables) < 40 * 40 * 5
        whole.append(sorted(tuple(x.values()) for t in tables for x in roadmap._later_of_block(t).to_pylist()))
    assert whole[0] == whole[1] and [x for x in whole[0] if x[0] == 9] == [(9, 39, 0)]


def test_streams(spark, tmp_path):
    kinds = T.StructType.fromDDL("ts timestamp, event_type string, value double, user_id long, event_id long")
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value, 1L user_id, 1L event_id UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D, 1L, 2L").write.parquet(src)
    q = streams.tumbling(streams.read_events(spark, src, kinds)).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.table("w").collect()] == [("a", 2, 3.0)]
    q = streams.upsert_stream(streams.read_events(spark, src, kinds), f"{tmp_path}/out", ["user_id"], "event_id", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    spark.sql("SELECT timestamp'2024-01-02 00:10:00' ts, 'b' event_type, 1.0D value, 1L user_id, 9L event_id").write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert [(r.user_id, r.event_id) for r in streams.latest(spark, f"{tmp_path}/out").collect()] == [(1, 9)]
