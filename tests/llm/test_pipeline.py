import pytest

import corpus_pipeline
from litmill.llm import decontaminate, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = docs.cache()
        docs.count()
        out[name] = docs
    return out


def test_stages(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_file"]
    for n in names[:-1]:
        assert steps[n].columns == steps["documents"].columns
    assert 0.97 * steps["documents"].count() <= steps["language_id"].count() <= steps["documents"].count()


def test_no_copies_or_items_left(spark, steps):
    texts = [r.text for r in steps["near_dedup"].select("text").collect()]
    assert len(texts) == len(set(texts)) and {r.text for r in steps["language_id"].select("text").collect()} >= set(texts)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(steps["decontamination"], items).count() == 0
    leaked = [r.text for r in items.collect()]
    assert not any(t in d for d in (r.text for r in steps["decontamination"].collect()) for t in leaked)


def test_mixture_and_file(spark, steps):
    want = sum(r.taken for r in mixing.mix(steps["decontamination"]).collect())
    assert sum(len(r.text.split()) for r in steps["mixing"].collect()) == want
    rows = sorted(steps["token_file"].collect(), key=lambda r: r.start)
    assert len(rows) == steps["mixing"].count() and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_run(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps["token_file"].collect()))


def stages(spark, docs, sf):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf))
        if len(out) <= 5:
            assert out[-1].columns == docs.columns
        rows = out[-1].collect()
        out[-1] = spark.createDataFrame(rows, out[-1].schema)
    return out


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = {"row_key": "a", "own_hash": "b", "taken_copies": "c", "component_id": "d", "key": "e", "hash": "f"}
    more = [(None, None, None, None, 1), (7001, None, "en", "s", 1), (7002, "", "en", None, 1), (None, docs.first().text, None, "s", 1), (7003, "word " * 20000, "en", "s", 1), (7003, "word " * 20000, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).selectExpr("*", *[f"concat('{v}', doc_id) AS `{k}`" for k, v in names.items()])
    out = stages(spark, docs, SF)
    assert out[5].count() == out[4].count() > 0
    for step in out[1:5]:
        assert all(r[k] == (None if r.doc_id is None else f"{v}{r.doc_id}") for r in step.collect() for k, v in names.items())
    assert {r.text for r in out[2].collect()} <= {r.text for r in out[1].collect()} <= {r.text for r in docs.collect()}
    kept = [r.text for r in out[2].collect()]
    assert len(kept) == len(set(kept))


def test_empty_table(spark):
    out = stages(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
    assert [d.count() for d in out] == [0] * 6
