"""Deduplication and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.functions.arrays import far_apart, largest_gap


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` should be total, or ties are arbitrary."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def distinct_papers(papers: DataFrame) -> DataFrame:
    """One row per pmid: the longest abstract, then the latest fetch where known, then title, journal and year."""
    order = [F.length("abstract").desc_nulls_last()]
    order += [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in papers.columns else []
    order += [F.col(c).asc_nulls_last() for c in ("title", "journal_slug", "year") if c in papers.columns]
    return first_per_key(papers, ["pmid"], order)


def integrity(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n_total, n_distinct, n_duplicates): rows, different keys, rows in excess of one per key."""
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.countDistinct(key).alias("n_distinct")).withColumn("n_duplicates", F.col("n_total") - F.col("n_distinct"))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; ValueError if a key is null or repeats."""
    row = integrity(df, [key]).first()
    if row.n_duplicates:
        raise ValueError(f"{key} is not unique: {row.n_total} rows, {row.n_distinct} different keys (a null key counts as repeated)")
    return df


def drifted(n_duplicates: int, expected: int = 13_070) -> bool:
    """Whether the count of duplicates is further from the expected one than the larger of 500 and a quarter of it."""
    return abs(n_duplicates - expected) > max(500, expected // 4)


def distinct_vectors(vectors: DataFrame, key: str = "pmid", vector: str = "embedding", ordinal: str = "ordinal", tolerance: float = 1e-3) -> DataFrame:
    """The first vector of each key in file order; ValueError if a later one differs by more than the tolerance."""
    firsts = vectors.groupBy(key).agg(F.min(F.struct(ordinal, vector)).alias("f")).select(key, F.col("f")[ordinal].alias("_at"), F.col("f")[vector].alias("_first"))
    later = vectors.join(firsts, key).filter(F.col(ordinal) > F.col("_at"))
    wrong = later.filter((F.size("_first") != F.size(vector)) | far_apart(F.col("_first"), F.col(vector), tolerance))
    if bad := wrong.select(key, largest_gap(F.col("_first"), F.col(vector)).alias("gap")).orderBy(key).take(1):
        raise ValueError(f"divergent duplicate embeddings: {key} {bad[0][key]}, largest difference {bad[0].gap}")
    return vectors.join(firsts.select(key, "_at"), key).filter(F.col(ordinal) == F.col("_at")).drop("_at")


def require_known(ids: DataFrame, known: DataFrame, key: str = "pmid") -> None:
    """ValueError with the first five ids that are not known."""
    missing = [r[0] for r in ids.join(known, key, "left_anti").select(key).distinct().orderBy(key).limit(5).collect()]
    if missing:
        raise ValueError(f"ids without a record, among them {missing}")


def united_first(sources: list[DataFrame], key: str, ordinal: str) -> DataFrame:
    """The union of id lists; an id belongs to the source of the lowest ordinal that lists it."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s)
    return union.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def same_ids(a: DataFrame, b: DataFrame, key: str = "pmid") -> bool:
    """Whether two tables hold the same set of ids."""
    keys = [x.select(key).distinct() for x in (a, b)]
    return keys[0].join(keys[1], key, "left_anti").isEmpty() and keys[1].join(keys[0], key, "left_anti").isEmpty()
