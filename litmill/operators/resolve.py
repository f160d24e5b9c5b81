"""Authors and institutions brought to canonical ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.functions.text import compatible, first_initial, heuristic_id, last_name, short_hash
from litmill.operators.dedup import first_per_key
from litmill.session import expose_package, written

#: The salt of heuristic author ids; an existing corpus keeps its ids by passing its own.
SALT = "authors_v1"


#: Rows of a task of the window over papers.
TASK_ROWS = 500_000


def position_flags(rows: DataFrame, key: str = "pmid", position: str = "author_position", label: str = "author_position_label") -> DataFrame:
    """Adds is_first and is_last: by the label in any case where there is one, else by the least and the largest
    position of the paper. Rows are counted first: more of them make more tasks, not larger ones."""
    w = Window.partitionBy(key)
    tasks = -(-rows.count() // TASK_ROWS)
    rows = rows.repartition(tasks, key) if tasks > 1 else rows
    text = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    at = F.coalesce(F.col(position), F.lit(0))
    return rows.withColumn("is_first", F.when(text != "", text == "first").otherwise(at == F.min(at).over(w))).withColumn("is_last", F.when(text != "", text == "last").otherwise(at == F.max(at).over(w)))


def signals(staging: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, signal): the most frequent institution id of a group's pooled institutions, first seen of equals;
    without any, the most frequent country; without either, empty."""
    order = F.struct(F.col("pmid"), F.coalesce("author_position", F.lit(0)))
    pooled = staging.select(*keys, order.alias("o"), F.posexplode_outer("institutions").alias("i", "inst"))
    value = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("inst.oa_id").alias("v")), F.struct(F.lit(1).alias("rank"), F.col("inst.country_code").alias("v"))))
    counts = pooled.select(*keys, F.struct("o", "i").alias("seen"), value.alias("s")).filter("s.v IS NOT NULL AND s.v <> ''")
    counts = counts.groupBy(*keys, F.col("s.rank").alias("rank"), F.col("s.v").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    best = first_per_key(counts, keys, [F.asc("rank"), F.desc("n"), F.asc("seen"), F.asc("v")])
    return best.select(*keys, F.col("v").alias("signal"))


#: Names whose signals are broadcast; beyond it they are joined by name and one of so many parts of the rows.
BROADCAST_NAMES, PARTS = 20_000, 64


def with_signals(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the signal of their keys. However many rows have one name, no task gets them all: few signals go to every
    task, many are repeated for each part into which a name's rows are dealt."""
    if found.count() <= BROADCAST_NAMES:
        return rows.join(F.broadcast(found), keys, "left")
    parted = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("pmid", "author_position"), F.lit(PARTS)))
    return dealt.join(parted, [*keys, "_part"], "left").drop("_part")


def canonical_id(orcid: Column, own_id: Column, last: Column, initial: Column, signal: Column, salt: str = SALT) -> Column:
    return F.when(orcid != "", F.concat(F.lit("ORCID:"), orcid)).when(own_id != "", F.concat(F.lit("OA:"), own_id)).otherwise(heuristic_id(salt, last, initial, signal))


def authors(staging: DataFrame, salt: str = SALT) -> DataFrame:
    """Rows of authorships of the staging table: ORCID, else the service's id, else a hash of name and signal, which
    rows of the same folded last name and initial share."""
    expose_package(staging.sparkSession)
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = staging.withColumn("oa", trimmed("author_oa_id")).withColumn("orcid", trimmed("author_orcid"))
    rows = rows.withColumn("last", last_name(F.col("author_display_name"))).withColumn("initial", first_initial(F.col("author_display_name")))
    unknown = rows.filter("oa = '' AND orcid = ''")
    joined = with_signals(position_flags(rows), written(signals(unknown, ["last", "initial"]), "signals"), ["last", "initial"])
    method = F.when(F.col("orcid") != "", "orcid").when(F.col("oa") != "", "openalex").otherwise("heuristic")
    return joined.select(
        "pmid", F.coalesce("author_position", F.lit(0)).alias("author_position"), trimmed("author_position_label").alias("author_position_label"), F.col("oa").alias("author_oa_id"),
        F.col("orcid").alias("author_orcid"), F.coalesce("author_display_name", F.lit("")).alias("author_display_name"),
        canonical_id(F.col("orcid"), F.col("oa"), F.col("last"), F.col("initial"), F.col("signal"), salt).alias("author_canonical_id"), method.alias("disambiguation_method"), "is_first", "is_last",
    )


def institutions(staging: DataFrame, cache: DataFrame, gate: float = 0.85, unify: bool = False) -> tuple[DataFrame, DataFrame]:
    """(institutions, paper_institutions). Listed institutions go by the service's id, the registry's, or a hash of
    their name; where none is listed the first raw text is looked up in ``cache``, else hashed. Attributes are those
    of the first sighting. ``unify`` writes both forms of registry ids alike."""
    expose_package(staging.sparkSession)
    order = F.struct(F.col("pmid").alias("p"), F.coalesce("author_position", F.lit(0)).alias("a"))
    raw_hash = lambda c: F.concat(F.lit("RAW:"), short_hash(compatible(c)))
    listed = staging.filter(F.size("institutions") > 0).select("pmid", "author_position", order.alias("o"), F.posexplode("institutions").alias("i", "x"))
    name = F.coalesce("x.display_name", F.lit(""))
    by_id = F.when(F.coalesce("x.oa_id", F.lit("")) != "", F.concat(F.lit("OA:"), "x.oa_id")).when(F.coalesce("x.ror_id", F.lit("")) != "", F.concat(F.lit("ROR:"), "x.ror_id")).when(F.trim(name) != "", raw_hash(name))
    matched = F.when((F.coalesce("x.oa_id", F.lit("")) != "") | (F.coalesce("x.ror_id", F.lit("")) != ""), "openalex").otherwise("unmatched")
    a = listed.select(
        "pmid", "author_position", F.struct("o", "i").alias("seen"), by_id.alias("id"), F.coalesce("x.oa_id", F.lit("")).alias("oa"), F.coalesce("x.ror_id", F.lit("")).alias("ror"), name.alias("name"),
        F.coalesce("x.country_code", F.lit("")).alias("country"), F.coalesce("x.type", F.lit("")).alias("kind"), name.alias("raw"), matched.alias("how"),
    ).filter("id IS NOT NULL")
    bare = staging.filter((F.size("institutions") <= 0) | F.col("institutions").isNull()).withColumn("raw", F.trim(F.coalesce(F.try_element_at("raw_affiliation_strings", F.lit(1)), F.lit("")))).filter("raw <> ''")
    known = cache.filter((F.col("match_score") >= gate) & (F.coalesce("ror_id", F.lit("")) != "")).select(F.col("raw_string").alias("_raw"), "ror_id", "ror_display_name", "country_code", "type")
    known = known.withColumn("_nth", F.row_number().over(Window.partitionBy("_raw").orderBy("ror_id"))).filter("_nth = 1").drop("_nth")
    b = bare.join(known, F.col("raw") == F.col("_raw"), "left")
    hit = F.col("ror_id").isNotNull()
    b = b.select(
        "pmid", "author_position", F.struct(order.alias("o"), F.lit(0).alias("i")).alias("seen"), F.when(hit, F.concat(F.lit("ROR:"), "ror_id")).otherwise(raw_hash(F.col("raw"))).alias("id"), F.lit("").alias("oa"),
        F.coalesce("ror_id", F.lit("")).alias("ror"), F.when(hit, F.col("ror_display_name")).otherwise(F.col("raw")).alias("name"), F.coalesce("country_code", F.lit("")).alias("country"),
        F.coalesce("type", F.lit("")).alias("kind"), "raw", F.when(hit, "ror_api").otherwise("unmatched").alias("how"),
    )
    rows = a.unionByName(b)
    if unify:
        rows = rows.withColumn("id", F.regexp_replace("id", "^ROR:https://ror.org/", "ROR:"))
    firsts = rows.groupBy("id").agg(F.min(F.struct("seen", "oa", "ror", "name", "country", "kind")).alias("f"))
    table = firsts.select(F.col("id").alias("institution_canonical_id"), F.col("f.oa").alias("institution_oa_id"), F.col("f.ror").alias("ror_id"), F.col("f.name").alias("display_name"), F.col("f.country").alias("country_code"), F.col("f.kind").alias("type"))
    links = rows.select("pmid", F.coalesce("author_position", F.lit(0)).alias("author_position"), F.col("id").alias("institution_canonical_id"), F.col("raw").alias("raw_affiliation_string"), F.col("how").alias("ror_matched_by"))
    return table, links
