import json
import time
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litmill.operators import index, labels, reports, topics, vectors
from litmill.sources import drivers, search, tables, workbooks


class Flaky:
    def __init__(self, failures=0):
        self.calls, self.failures = [], failures

    def lookup(self, ids):
        self.calls.append(list(ids))
        if len(self.calls) <= self.failures or "bad" in ids:
            raise OSError("down")
        return {i: json.dumps({"id": i}) for i in ids if i != "gone"}


def test_batches_retries_and_fallback():
    slept = []
    client = Flaky(2)
    assert drivers.lookup_batch(client, ["a", "b"], sleep=slept.append) == {"a": '{"id": "a"}', "b": '{"id": "b"}'} and slept == [1.0, 2.0]
    assert drivers.lookup_batch(client, []) == {} and len(client.calls) == 3
    with pytest.raises(ValueError, match="3 ids"):
        drivers.lookup_batch(client, ["a", "b", "c"], size=2)
    client = Flaky()
    rows = list(drivers.answers(client, ["a", "bad", "gone", "b"], size=3, attempts=1))
    assert [(i, s) for i, s, *_ in rows] == [("a", "ok"), ("bad", "error"), ("gone", "missing"), ("b", "ok")]
    assert client.calls == [["a", "bad", "gone"], ["a"], ["bad"], ["gone"], ["b"]]


def test_rate_limit():
    now, waits = [0.0], []

    def sleep(x):
        waits.append(x)
        now[0] += x

    limiter = search.RateLimiter(2, clock=lambda: now[0], sleep=sleep)
    for _ in range(6):
        limiter.acquire()
    assert now[0] == pytest.approx(2.0)
    patient = search.Patient(Asked({}), 2, sleep=sleep)
    assert patient.fetch([]) == search.EMPTY_SET and patient.search("x", 0, 1) == ([], 0)


class Asked:
    def __init__(self, totals):
        self.totals = totals

    def search(self, term, start, size):
        n = self.totals.get(term, 0)
        return [f"{term}-{i}" for i in range(start, min(n, start + size))], n


def test_years_are_split_to_days_and_no_id_is_lost(monkeypatch):
    monkeypatch.setattr(search, "SEARCH_CAP", 10)
    term = lambda date: f'"J"[TA] AND {date}[DP]'
    client = Asked({term("2001"): 40, term("2001/03"): 30, term("2001/03/05"): 9, term("2001/03/06"): 8, term("2001/04"): 7})
    assert len(search.search_year(client, "J", 2001)) == 24
    with pytest.raises(ValueError, match="11 ids"):
        search.search_year(Asked({term("2001"): 40, term("2001/03"): 30, term("2001/03/05"): 11}), "J", 2001)


def test_driver_needs_its_key(spark, tmp_path):
    class Local:  # so that workers needn't import this module
        def lookup(self, ids):
            return {i: f'{{"id": "{i}"}}' for i in ids if i != "gone"}

    ids = spark.createDataFrame([("a",), ("",), (None,), ("gone",)], "pmid string")
    none = drivers.drive(spark, str(tmp_path), "papers", ids, Local, needs_key=True)
    assert none == {"asked": 0, "ok": 0, "failed": 0} and tables.read_optional(spark, f"{tmp_path}/papers_failed.parquet").count() == 0
    assert drivers.drive(spark, str(tmp_path), "papers", ids, Local, key="k", needs_key=True) == {"asked": 2, "ok": 1, "failed": 1}
    assert drivers.documents(spark, str(tmp_path), "papers", "id string").select("document.id").first().id == "a"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/gone.json").write_text('{"id": "W"}')
    root = str(tmp_path / "docs")
    assert drivers.drive(spark, str(tmp_path), "papers", ids, lambda: drivers.LandedDocuments(root), key="k", needs_key=True) == {"asked": 1, "ok": 1, "failed": 0}
    assert tables.read_optional(spark, f"{tmp_path}/papers_failed.parquet").count() == 0


def planted(n=25, groups=4, dim=16):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(groups, dim))
    return [(g * n + i, (centres[g] / np.linalg.norm(centres[g]) + 0.05 * rng.normal(size=dim)).tolist()) for g in range(groups) for i in range(n)]


def test_index(spark, tmp_path, monkeypatch):
    rows = planted()
    v = spark.createDataFrame(rows, "pmid long, embedding array<double>")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -1)
    want = {i: set(np.argsort(-sims[i])[:10].tolist()) for i in range(len(rows))}
    for shard in (8192, 30):
        monkeypatch.setattr(index, "SHARD", shard)
        index.save(index.build(v, m=8, ef_construction=64), str(tmp_path / "i"))
        held = index.load(spark, str(tmp_path / "i"))
        assert sorted(r.row_id for r in held.collect()) == list(range(len(rows)))
        got = index.search(held, v, 10, ef=32).collect()
        assert sum(r.neighbour in want[r.query] for r in got) >= 0.9 * 10 * len(rows) and all(r.query != r.neighbour for r in got)
    assert index.lookup(held, v.filter("pmid IN (3, 4)")).count() == 2
    for bad, match in ((lambda: index.build(v, m=0), "at least"), (lambda: index.build(v.limit(0)), "no vectors"), (lambda: index.build(v.union(spark.createDataFrame([(900, [1.0])], v.schema))), "one length")):
        with pytest.raises(ValueError, match=match):
            bad()
    v.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="not an index"):
        index.load(spark, str(tmp_path / "plain"))


def test_row_ids_and_replaced_tables(spark, tmp_path):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "k long, v string").repartition(7)
    got = tables.with_row_ids(df, [F.col("k").desc()]).collect()
    assert {r.k: r.row_id for r in got} == {k: 999 - k for k in range(1000)}
    path = str(tmp_path / "t")
    tables.replace_table(df, path)
    tables.replace_table(spark.read.parquet(path).filter("k < 10"), path)
    assert spark.read.parquet(path).count() == 10 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_quartiles_with_equal_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [1] * 6 + [2, 3]], "v double")
    with pytest.raises(ValueError, match="coincide"):
        reports.quartiles(df, "v")
    got = {r.v: r.quartile for r in reports.quartiles(df, "v", duplicates="drop").collect()}
    values = pd.Series([1.0] * 6 + [2, 3])
    want = pd.qcut(values, 4, labels=False, duplicates="drop") + 1
    assert got == dict(zip(values, want, strict=True))


def test_windows_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["knee", "joint", "bone"]
    texts = [" ".join(rng.choice(["knee", "joint", "bone", "xx", "yy", "zz"], rng.integers(0, 40))) for _ in range(30)] + [None, "knee knee"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "pmid long, text string")
    for size in (10, 3, None):
        want = {}
        for x in texts:
            w = (x or "").split()
            for i in range((1 if size is None else max(1, len(w) - size + 1)) if w else 0):
                key = tuple(sorted(set(vocabulary) & set(w if size is None else w[i : i + size])))
                want[key] = want.get(key, 0) + 1
        got = {tuple(r.terms): r.n for r in topics._windows(df, vocabulary, size, "pmid", "text").groupBy("terms").agg(F.sum("n").alias("n")).collect()}
        assert got == want


def test_windows_of_long_texts_and_many_words(spark):
    """Time grows with the tokens: every other token of a long text is one of 130 words."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(130)]
    w = [f"w{i}" for i in rng.integers(0, 260, 60_000)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:9])), (3, ""), (4, "w3")], "pmid long, text string")
    known, want = set(vocabulary), {}
    for x in (w, w[:9], ["w3"]):
        for i in range(max(1, len(x) - 9)):
            key = tuple(sorted(known & set(x[i : i + 10])))
            want[key] = want.get(key, 0) + 1
    begun = time.time()
    got = {tuple(r.terms): r.n for r in topics._windows(df, vocabulary, 10, "pmid", "text").groupBy("terms").agg(F.sum("n").alias("n")).collect()}
    assert got == want and time.time() - begun < 60


def test_automatic_reduction():
    centres = np.array([[1.0, 0.0], [0.99, 0.05], [0.0, 1.0]])
    labels, left = topics._merged(np.array([0, 0, 1, 2, 2, -1]), centres, 1, topics.NEAR_TOPICS)
    assert labels.tolist() == [0, 0, 0, 1, 1, -1] and len(left) == 2


def test_workbook(spark, tmp_path):
    rows = [(3, "a <b> & c\x01", None), (12, "é😀 line\nbreak", "x" * 40_000)]
    sample = spark.createDataFrame(rows, "pmid long, title string, abstract string")
    path = str(tmp_path / "s.xlsx")
    assert workbooks.write_sheet(labels.sheet(sample, "r1"), path) == 2
    with zipfile.ZipFile(path) as z:
        body = z.read("xl/worksheets/sheet1.xml").decode()
        assert body.count("<dataValidation ") == 5 and "RCT,cohort" in body and len(z.namelist()) == 6
    got = workbooks.read_sheet(spark, path).orderBy(F.col("pmid").cast("int")).collect()
    assert [(r.pmid, r.rater, r.title, r.abstract) for r in got] == [("3", "r1", "a <b> & c", None), ("12", "r1", "é😀 line\nbreak", "x" * 40_000)]
    with pytest.raises(ValueError, match="expected the columns"):
        workbooks.read_sheet(spark, path, ["pmid"])


def test_workbooks_of_a_long_sheet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    sample = spark.createDataFrame([(i, None if i == 4 else f"t{i}\nx", "a") for i in range(8)], "pmid long, title string, abstract string")
    path = str(tmp_path / "s.xlsx")
    assert workbooks.write_sheet(labels.sheet(sample, "r1"), path) == 8 and len(list(tmp_path.iterdir())) == 3
    got = {(r.pmid, r.title) for r in workbooks.read_sheet(spark, path).collect()}
    assert got == {(str(i), None if i == 4 else f"t{i}\nx") for i in range(8)}
    assert [r[0] for r in workbooks._body(str(tmp_path / "s.part2.xlsx"), workbooks.HEADER)] == ["3", "4", "5"]
    with pytest.raises(ValueError, match="expected the columns"):
        workbooks.read_sheet(spark, path, ["pmid"])
    assert workbooks.write_sheet(labels.sheet(sample.limit(2), "r1"), path) == 2 and len(list(tmp_path.iterdir())) == 1
    assert workbooks.read_sheet(spark, path).count() == 2


def test_shared_strings_and_blank_rows(spark, tmp_path):
    ns = f'xmlns="{workbooks.MAIN}"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a</t></si><si><r><t>one </t></r><r><t>two</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = workbooks.read_sheet(spark, str(tmp_path / "x.xlsx"), ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("one two", "TRUE"), ("7", None)]


def test_encoder_settings(spark):
    seen = []

    def make(name, device=None, revision=None, max_length=None):
        seen.append((name, device, revision, max_length))
        return vectors.make_encoder(name, max_length=max_length)

    df = spark.createDataFrame([(1, "one two three"), (2, "one two four")], "pmid long, text string")
    a, b = (r.embedding for r in vectors.embed(df, make=make, device="cpu", revision="r", max_length=2).orderBy("pmid").collect())
    assert a == b and seen[0] == ("mpnet", "cpu", "r", 2)
    with pytest.raises(ValueError, match="batch"):
        vectors.embed(df, batch=0)
