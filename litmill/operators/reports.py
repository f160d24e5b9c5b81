"""Descriptive and coverage reports over papers and enrichment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.functions.arrays import indicator
from litmill.functions.dates import ERAS_OF_REPORT, era_of_report


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def trend(papers: DataFrame, group: str, year: str = "year") -> DataFrame:
    """Papers per group and known year."""
    return count_by(papers.filter(F.col(year).isNotNull()), group, year)


def rate_by(df: DataFrame, keys: list, condition: Column, name: str = "rate") -> DataFrame:
    """The share of rows of each group that meet a condition."""
    return df.groupBy(*keys).agg(F.avg(indicator(condition)).alias(name))


def rate_by_era(papers: DataFrame, group: str, condition: Column, year: str = "year", name: str = "rate") -> DataFrame:
    return rate_by(papers, [F.col(group), era_of_report(F.col(year)).alias("era")], condition, name)


def matrix(long: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Long to wide with fixed columns; other columns' rows only keep their row in place."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value))


def overall_rate(papers: DataFrame, where: Column, condition: Column) -> float | None:
    """The share among the rows of ``where``; None if there are none."""
    return papers.filter(where).agg(F.avg(indicator(condition)).alias("r")).first().r


def coverage(papers: DataFrame, metrics: dict[str, DataFrame], group: str, year: str, key: str = "pmid") -> DataFrame:
    """Rows (group, era, metric, rate): the share of papers whose key occurs in the metric's keys (column ``key``)."""
    joined = papers
    for name, keys in metrics.items():
        joined = joined.join(keys.select(F.col(key)).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    rates = joined.groupBy(F.col(group), era_of_report(F.col(year)).alias("era")).agg(*[F.avg(indicator(F.col(f"_{m}"))).alias(m) for m in metrics])
    return rates.unpivot([group, "era"], list(metrics), "metric", "rate")


def coverage_matrix(papers: DataFrame, metrics: dict[str, DataFrame], group: str, year: str, key: str = "pmid") -> DataFrame:
    """``coverage`` with one column per known era."""
    return coverage(papers, metrics, group, year, key).groupBy(group, "metric").pivot("era", ERAS_OF_REPORT).agg(F.first("rate"))


def histogram(df: DataFrame, value: Column, bins: int = 60) -> DataFrame:
    """Rows (bin from 1, n) of equal widths between the least and the largest value, which falls into the last bin."""
    values = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)) + 1
    return values.join(F.broadcast(ends)).select(F.least(place, F.lit(bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def frequent_terms(pairs: DataFrame, term: str, key: str, total: int, most_percent: float, top: int) -> DataFrame:
    """The ``top`` terms of most keys among those of at most ``most_percent`` of all keys; ties by term."""
    counts = pairs.groupBy(term).agg(F.countDistinct(key).alias("n"))
    return _most_frequent(counts, F.lit(total), term, most_percent, top)


def _most_frequent(counts: DataFrame, total: Column, term: str, most_percent: float, top: int) -> DataFrame:
    return counts.filter(F.lit(100.0) * F.col("n") / total <= most_percent).select(term, "n").orderBy(F.desc("n"), term).limit(top)


def frequent_words(docs: DataFrame, words: Column, key: str, most_percent: float, top: int) -> DataFrame:
    """``frequent_terms`` of the different elements of ``words``, a column of ``docs``, whose keys must be unique: counts
    alone are shuffled, and the number of documents is a row of the same plan."""
    counts = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(docs.agg(F.countDistinct(key).alias("total")))  # one row
    return _most_frequent(counts.join(total), F.col("total"), "term", most_percent, top)


def shares(df: DataFrame, group: str, period: str) -> DataFrame:
    """Rows (group, period, n, share of the period) on the full grid, 0 where nothing occurs."""
    rows = df.filter(F.col(group).isNotNull() & F.col(period).isNotNull())
    counts = rows.groupBy(group, period).agg(F.count(F.lit(1)).alias("n"))
    periods = F.broadcast(rows.agg(F.collect_set(period).alias("p")))  # a value for each period
    grid = rows.select(group).distinct().join(periods).select(group, F.explode("p").alias(period))
    dense = grid.join(counts, [group, period], "left").select(group, period, F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(period))
    return dense.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def counts_of_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, value: str, name: str = "quartile", duplicates: str = "raise") -> DataFrame:
    """Adds the quartile, from 1, by interpolated edges, closed on the right. Where edges coincide: ValueError, or with
    ``duplicates="drop"`` fewer bins."""
    edges = df.agg(F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("e")).first().e
    if edges is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    if len(set(edges)) < 5 and duplicates != "drop":
        raise ValueError(f"the quartile edges of {value} coincide: {edges}")
    bins = None
    for n, edge in enumerate(sorted(set(edges))[1:], 1):
        bins = (bins if bins is not None else F).when(F.col(value) <= edge, n)
    return df.withColumn(name, bins if bins is not None else F.lit(None).cast("int"))


def spot_check(assigned: DataFrame, titles: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """The ``n`` rows of each quartile of the highest values, with what ``titles`` says of their keys."""
    best = top_per_group(quartiles(assigned, value, duplicates="drop"), ["quartile"], [F.desc(value), F.asc(key)], n)
    return best.join(titles, key, "left")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def mode_first_seen(df: DataFrame, group: str, value: str, ordinal: str) -> DataFrame:
    """Each group's most frequent non-empty value; of equals the one seen first."""
    counts = df.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("at"))
    return top_per_group(counts, [group], [F.desc("n"), F.asc("at")], 1).select(group, value, "n")


def internal_citations(references: DataFrame, works: DataFrame) -> DataFrame:
    """References with the pmid and year of works that the corpus holds."""
    known = works.select(F.col("openalex_id").alias("_id"), F.col("pmid").alias("_pmid"), F.col("publication_year").alias("_year"))
    joined = references.join(known, F.col("ref_openalex_id") == F.col("_id"), "left")
    return joined.select(
        "citing_pmid", "ref_openalex_id", F.coalesce("_pmid", "ref_pmid_if_known").alias("ref_pmid_if_known"), F.coalesce("_year", "ref_year").alias("ref_year"), "ref_position"
    )
