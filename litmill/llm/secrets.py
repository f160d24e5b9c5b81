"""Operator 5: secret scans with fixed patterns and character Markov models, in DataFrame functions only.

Three patterns give the base spans. The method adds spans of kind ``model``: runs of 16 or more token characters with
a letter, and with a digit or a capital after the first letter, whose log-likelihood under a first-order Markov model
of random strings exceeds that under a model of ordinary identifiers by ``THRESHOLD``. They never overlap base spans.

Random strings are written-out digests; ordinary identifiers are words of a bounded sample of the documents and
their usual compounds (Capitalised, UPPER, snake_case, camelCase, with-hyphens, paths, with numbers). Both models
are counts of adjacent characters with one added to each.

Offsets count code points; the end is exclusive. A null text counts as empty; texts are read whole, and the spans of a
long one cost no more each than those of a short one; rows of equal id and text are scanned alike; columns other than
the id and text are left out, so no name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.llm.common import lowest, row_key

KINDS = ("assign", "access", "hex", "model")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # whole runs: a run that is too short holds no longer one
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])(?=[A-Z]?[a-z+/_=-]*[0-9A-Z])[A-Za-z0-9+/_=-]{16,}"
#: Log-likelihood ratio, in nats, from which a token is a secret.
THRESHOLD = 20.0
#: Bounds of the training sample: documents of the lowest hashes, and random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 20_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def _place(char: Column) -> Column:
    return F.instr(F.lit(ALPHABET), char)


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts (label, pair) of adjacent characters of rows (label, token)."""
    at = F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i")
    each = tokens.filter(F.length("token") > 1).select("label", "token", at)
    return each.groupBy("label", F.expr("substring(token, i, 2)").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """Labelled samples of random strings: digests in hexadecimal, base 64, and capitals with digits."""
    digest = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    capitals = F.translate(F.upper(F.base64(F.unhex("d"))), "+/=", "XYZ")
    return digest.select(F.explode(F.array("d", F.base64(F.unhex("d")), capitals)).alias("token"), F.lit("random").alias("label"))


def ordinary_identifiers(docs: DataFrame, id_column: str, text_column: str, n: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples of ordinary identifiers from the ``n`` different documents of the lowest id hashes."""
    known = docs.filter(F.col(text_column).isNotNull() & F.col(id_column).isNotNull())
    hashed = known.select(F.xxhash64(F.col(id_column).cast("string")).alias("h"), F.xxhash64(text_column).alias("t"), F.col(text_column).alias("text"))
    top = lowest(hashed.select("h", "t"), n, []).agg(F.max(F.struct("h", "t")).alias("top")).first().top
    if top is None:
        return docs.sparkSession.createDataFrame([], "token string, label string")
    sample = hashed.filter(F.struct("h", "t") <= F.struct(F.lit(top.h), F.lit(top.t))).groupBy("h", "t").agg(F.first("text").alias("text"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,15}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    rows = sample.select(words.alias("w")).select(F.posexplode(F.arrays_zip(F.col("w"), F.expr("slice(w, 2, greatest(size(w), 1))").alias("v")))).select("pos", F.lower("col.w").alias("w"), F.lower(F.coalesce("col.v", "col.w")).alias("v"))
    forms = F.array(
        "w", F.initcap("w"), F.upper("w"), F.concat("w", F.lit("_"), "v"), F.concat("w", F.initcap("v")), F.concat("w", F.lit("-"), "v"),
        F.concat("w", F.lit("/"), "v"), F.concat("w", F.col("pos").cast("string")), F.concat(F.upper("w"), F.lit("_"), F.upper("v")), F.concat("w", F.lit("="), "v"),
    )
    return rows.select(F.explode(forms).alias("token"), F.lit("ordinary").alias("label"))


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, by place in ``ALPHABET`` squared."""
    tokens = random_strings(docs.sparkSession).unionByName(ordinary_identifiers(docs, id_column, text_column))
    counts: dict[str, dict[str, int]] = {"random": {}, "ordinary": {}}
    for row in _pairs(tokens).collect():  # two rows for each pair of the alphabet at most
        counts[row.label][row.pair] = row.n
    known = set(ALPHABET)
    size = len(ALPHABET)

    def logs(label: str) -> dict[str, float]:
        own = {p: n for p, n in counts[label].items() if set(p) <= known}
        total = {a: sum(own.get(a + b, 0) for b in ALPHABET) + size for a in ALPHABET}
        return {a + b: math.log((own.get(a + b, 0) + 1) / total[a]) for a in ALPHABET for b in ALPHABET}

    random, ordinary = logs("random"), logs("ordinary")
    return [random[a + b] - ordinary[a + b] for a in ALPHABET for b in ALPHABET]


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token."""
    values = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")  # folded to a constant
    places = F.transform(F.split(token, ""), _place)
    steps = F.zip_with(F.slice(places, F.lit(1), F.length(token) - 1), F.slice(places, F.lit(2), F.length(token)), lambda a, b: F.element_at(values, ((a - 1) * len(ALPHABET) + b).cast("int")))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def _found(guard: Column, text: Column, pattern: str, kind: int, valid, group: int = 0) -> Column:
    """Entries (kind, pos, before: code points since the last match, size, valid) of all matches; ``valid`` takes the
    matched group. Texts that the guard excludes have none."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.zip_with(matched, groups, lambda m, g: F.struct(F.length(m).alias("size"), valid(g).alias("valid")))
    pieces = F.split(text, pattern, -1)
    rows = F.filter(F.zip_with(pieces, both, lambda p, m: F.struct(F.length(p).alias("before"), m.size.alias("size"), m.valid.alias("valid"))), lambda x: x.size.isNotNull())
    entries = F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.before.alias("before"), x.size.alias("size"), x.valid.alias("valid")))
    return F.when(guard, entries).otherwise(F.array().cast("array<struct<kind:int,pos:int,before:int,size:int,valid:boolean>>"))


def scan(docs: DataFrame, table: list[float] | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_model. Without a table no spans are added."""
    text = F.col("text")
    rows = docs.select(row_key(id_column, text_column).alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    yes = lambda g: F.lit(True)
    parts = [
        _found(text.rlike("(?i)password|passwd|secret|token|api_?key"), text, ASSIGN, 0, lambda g: F.length(g) >= 6, 2),
        _found(text.contains("AKIA"), text, ACCESS, 1, yes),
        _found(text.rlike("[0-9a-f]{24}"), text, HEX, 2, yes),
    ]
    if table is not None:
        parts.append(_found(text.rlike(TOKEN), text, TOKEN, 3, lambda g: ratio(g, table) >= THRESHOLD))
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("before"), F.lit(0).alias("size"), F.lit(False).alias("valid")))
    entries = rows.select("row", "id", F.explode(F.concat(mark, *parts)).alias("e")).select("row", "id", "e.*")
    entries = entries.groupBy("row", "id", "kind", "pos", "before", "size", "valid").agg(F.count(F.lit(1)).alias("copies")).repartition("row")
    running = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.withColumn("end", F.sum(F.col("before") + F.col("size")).over(running)).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("valid") & F.col("kind").between(0, 2)
    order = Window.partitionBy("row").orderBy("start", "kind", "pos")
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("pos"))
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    kept = placed.withColumn("kept", F.col("valid") & ((F.col("kind") < 3) | apart))
    span = F.struct("start", "kind", "end")
    count = lambda k: F.sum(F.when(F.col("kept") & (F.col("kind") == k), 1).otherwise(0)).cast("long")
    found = kept.groupBy("row").agg(
        F.first("id").alias("id"), F.max("copies").alias("copies"), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("all"),
    )
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    only_base = F.filter("all", lambda s: s.kind < 3)
    counts = [f"n_{name}" for name in KINDS]
    each = found.select("id", "copies", *counts, F.sha2(written(only_base), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("id").alias(id_column), *counts[:-1], "base_sha256", "spans", counts[-1])


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``scan`` with models trained on a sample of ``docs``."""
    return scan(docs, train(docs, id_column, text_column), id_column, text_column)
