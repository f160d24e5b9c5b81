from pyspark.sql import Row
from pyspark.sql import functions as F

from litmill.functions import arrays, dates, text


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_prefixes(spark):
    assert one(spark, text.strip_prefix(F.lit(" https://doi.org/10.1/x "), "https://doi.org/")) == "10.1/x"
    assert one(spark, text.strip_prefix(F.lit(None).cast("string"), "x")) == ""
    assert one(spark, text.trim_slashes(F.lit("/123/"))) == "123"


def test_names(spark):
    df = spark.createDataFrame([("Müller",), ("Ann O'Brien",), ("VAN DER BERG",), ("José-Maria",), ("",), (None,), ("Élise",)], "n string")
    got = df.select("n", text.last_name(F.col("n")).alias("l"), text.first_initial(F.col("n")).alias("i")).collect()
    assert [(r.l, r.i) for r in got] == [("muller", "m"), ("obrien", "a"), ("berg", "v"), ("josemaria", "j"), ("", ""), ("", ""), ("elise", "e")]


def test_tokens_and_ngrams(spark):
    assert one(spark, text.tokens(F.lit("The Knee-joint of A patient, x 42"))) == ["knee", "joint", "patient", "42"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["a b", "b c"]
    assert one(spark, text.ngrams(F.array(F.lit("a")), 2)) == []


def test_unfence(spark):
    cases = {'```json\n{"a": 1}\n```': '{"a": 1}', "```\n{}\n```": "{}", "```{}```": "{}", "{}": "{}", "``` x y\nz```": "x y\nz"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", text.unfence(F.col("t")).alias("x")).collect()} == cases


def test_preview_and_ids(spark):
    assert one(spark, text.preview(F.lit("a\nb"), 10)) == "a b"
    assert one(spark, text.preview(F.lit("x" * 300))) == "x" * 200 + "..."
    assert one(spark, text.heuristic_id("s", F.lit("last"), F.lit("i"), F.lit(None).cast("string"))).startswith("H:H")


def test_dates(spark):
    rows = [(2024, "Mar", "15"), (2024, "march", None), (2024, "3", "1"), (1998, "Foo", "1"), (None, "Mar", "1"), (2024, None, "2")]
    df = spark.createDataFrame(rows, "y int, m string, d string")
    got = [r.x for r in df.select(dates.iso_date(F.col("y"), F.col("m"), F.col("d")).alias("x")).collect()]
    assert got == ["2024-03-15", "2024-03-01", "2024-03-01", "", "", ""]
    assert one(spark, dates.year_within(F.lit("1995-1996 Winter"))) == 1995
    eras = spark.createDataFrame([(1999,), (2005,), (2015,), (2021,), (None,)], "y int").select(dates.era_of_sample(F.col("y")), dates.era_of_report(F.col("y"))).collect()
    assert [tuple(r) for r in eras] == [("pre2000", "pre-2000"), ("2000-2009",) * 2, ("2010-2019",) * 2, ("2020+",) * 2, ("2020+", "unknown")]


def test_arrays(spark):
    concepts = F.expr("array(named_struct('id','a','score',0.5D), named_struct('id','b','score',0.9D), named_struct('id','c','score',0.5D))")
    assert [c.id for c in one(spark, arrays.top_by_score(concepts, 2))] == ["b", "a"]
    assert one(spark, arrays.padded(F.array(F.lit(1)), 3)) == [1, None, None]
    assert one(spark, arrays.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) is None
    numbers = spark.createDataFrame([("12",), ("12.0",), ("1.5",), ("x",), ("-3",), ("",)], "t string").select(arrays.as_whole_number(F.col("t")).alias("x")).collect()
    assert [r.x for r in numbers] == [12, 12, None, None, -3, None]
