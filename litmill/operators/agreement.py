"""Agreement of two raters, from counts of their pairs of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(pairs: DataFrame, field: str = "field", a: str = "a", b: str = "b") -> DataFrame:
    """Rows (field, n, n_agree, kappa, alpha) of rated pairs; pairs with a null are dropped.

    Cohen's kappa and Krippendorff's nominal alpha; null below two pairs or with a single label. Only counts of
    label pairs are shuffled."""
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(field).alias("f"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    totals = known.groupBy("f").agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("agree"))
    sides = known.select("f", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("v"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("s"))
    labels = sides.groupBy("f", F.col("s.v").alias("v")).agg(F.sum("s.na").cast("double").alias("na"), F.sum("s.nb").cast("double").alias("nb"))
    moments = labels.groupBy("f").agg(F.count(F.lit(1)).alias("labels"), F.sum(F.col("na") * F.col("nb")).alias("ab"), F.sum((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb"))).alias("c2"))
    joined = totals.join(moments, "f")
    n, pe = F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    enough = (n >= 2) & (F.col("labels") > 1)
    kappa = F.when(enough, F.try_divide(F.col("agree") / n - pe, 1 - pe))
    alpha = F.when(enough, 1 - F.try_divide((2 * n - 1) * 2 * (n - F.col("agree")), 4 * n * n - F.col("c2")))
    return joined.select(F.col("f").alias(field), n.cast("long").alias("n"), F.col("agree").cast("long").alias("n_agree"), kappa.alias("kappa"), alpha.alias("alpha"))


def raters(long: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (field, a, b) of the items that both raters of a long label table have, by pmid and field."""
    x = long.filter(F.col("rater") == a).select("pmid", "field", F.col("value").alias("a"))
    return x.join(long.filter(F.col("rater") == b).select("pmid", "field", F.col("value").alias("b")), ["pmid", "field"]).select("field", "a", "b")


def kappa(a: list, b: list, spark) -> float:
    """Cohen's kappa of two lists; NaN where undefined."""
    return _of_lists(a, b, spark).kappa


def alpha(a: list, b: list, spark) -> float:
    """Krippendorff's nominal alpha of two lists; NaN where undefined."""
    return _of_lists(a, b, spark).alpha


def _of_lists(a: list, b: list, spark):
    from types import SimpleNamespace

    if len(a) != len(b):
        raise ValueError("the raters have different numbers of labels")
    text = lambda x: None if x is None else str(x)
    rows = summary(spark.createDataFrame([("x", text(x), text(y)) for x, y in zip(a, b, strict=True)], "field string, a string, b string")).collect()
    nan = lambda x: float("nan") if x is None else x
    return SimpleNamespace(kappa=nan(rows[0].kappa if rows else None), alpha=nan(rows[0].alpha if rows else None))


def concordance(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, ccc): Lin's concordance correlation of the pairs without null."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = known.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    return m.select("n", F.try_divide(2 * F.col("c"), F.col("vx") + F.col("vy") + (F.col("mx") - F.col("my")) * (F.col("mx") - F.col("my"))).alias("ccc"))


def codes(df: DataFrame, value: str, name: str = "code") -> DataFrame:
    """Adds a number from 0 for each different value, in the order of their texts; null has none. Values are few."""
    domain = df.filter(F.col(value).isNotNull()).select(value).distinct()
    ranked = domain.withColumn(name, F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col(value).cast("string"))) - 1)
    return df.join(ranked, value, "left")
