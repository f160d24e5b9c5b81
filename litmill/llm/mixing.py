"""Operator 6: mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is how often its documents are taken: the whole part by all of them, the rest by a
sample. The sample starts from that fraction as every document's inclusion probability and moves it, three open
documents at a time, along the null space of the constraints (number of documents, number of words) until each step
has settled a document; so both totals stay at their expected values. Documents are dealt to buckets of about
``BUCKET`` by a hash; the two at most that stay open in a bucket meet those of the other buckets of their source in
the next round, until one bucket per source remains, whose last two open documents are the landing problem: they
settle so that the number of words comes nearest. Long documents go first, so that short ones are left to balance
them. Random numbers depend on the source, round and bucket alone, so reruns agree.

Rows with the same id, source and text are one document and are taken together. A null text has size 0; null ids and
sources are values of their own, and the null source is ordered last; texts are counted whole; ``mixed`` carries extra
columns along whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Scratch, broadcast_if_small, expose_package, release, running, unused

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BUCKET = 4096
SEED = 20240229
EDGE = 1e-9
OUTSIZED = 0.01
WORD = r"[^\x20\x09-\x0D]+"


def words(text_column: str = "text") -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, n, source_size) with rank (by code point, null last) and target.

    The targets are min(level * weight, most * size) at the level where they add up to all sizes: in the order of
    the level at which a source is full, the level among those that are not full yet is known from running totals."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = running(scratch, sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    ranked = scratch.write(ranked.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(most))))
    order = [(F.col("full") / F.col("weight")).asc(), F.col("rank").asc()]
    leveled = running(scratch, ranked, order, {"full_before": F.col("full"), "weight_before": F.col("weight")})
    whole = F.broadcast(ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")))  # one row
    level = (F.col("words") - F.col("full_before")) / (F.col("weights") - F.col("weight_before"))
    leveled = scratch.write(leveled.join(whole).withColumn("level", level).withColumn("open", F.col("full") / F.col("weight") > F.col("level")))
    first = F.broadcast(leveled.agg(F.max(F.when(F.col("open"), F.col("level"))).alias("first")))  # one row; levels fall from the first open source on
    target = F.when(F.col("open"), F.col("first") * F.col("weight")).otherwise(F.col("full"))
    return leveled.join(first).withColumn("target", F.least(target, F.col("full"))).select("source", "n", "source_size", "rank", "target")


def _outsized(size: list[float], p: list[float], draws: list[float]) -> int:
    """Settles open documents of over ``OUTSIZED`` of the words, which steps among three would leave for the end: all
    others move a little the other way, along the null space of the words alone. Returns the draws used."""
    rest, used = sum(s for s, q in zip(size, p, strict=True) if EDGE < q < 1 - EDGE), 0
    for i in sorted(range(len(p)), key=lambda i: -size[i]):
        if not EDGE < p[i] < 1 - EDGE:
            continue
        others = rest - size[i]
        if size[i] <= OUTSIZED * rest or others <= 0:
            break
        taken = float(draws[used] < p[i])
        used += 1
        shift = size[i] * (p[i] - taken) / others
        among = [j for j in range(len(p)) if j != i and EDGE < p[j] < 1 - EDGE]
        if any(not EDGE < p[j] + shift < 1 - EDGE for j in among):
            continue
        p[i], rest = taken, others
        for j in among:
            p[j] += shift
    return used


def settle(size: list[float], p: list[float], draws: list[float], last: bool) -> None:
    """Moves the probabilities ``p`` in place until at most two are open, or none if ``last``."""
    d = _outsized(size, p, draws)
    held: list[int] = []
    following, n = 0, len(p)
    while True:
        while len(held) < 3 and following < n:
            if EDGE < p[following] < 1 - EDGE:
                held.append(following)
            following += 1
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            move = (c - b, a - c, b - a) if a != b or b != c else (1.0, -1.0, 0.0)
        else:
            break
        up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in zip(held, move, strict=True) if u)
        down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in zip(held, move, strict=True) if u)
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        for i, u in zip(held, move, strict=True):
            p[i] += step * u
            if p[i] <= EDGE or p[i] >= 1 - EDGE:
                p[i] = float(round(p[i]))
        held = [i for i in held if EDGE < p[i] < 1 - EDGE]
    if last and held:
        expected = sum(size[i] * p[i] for i in held)
        ways = product((0.0, 1.0), repeat=len(held))
        for i, s in zip(held, min(ways, key=lambda way: abs(sum(size[i] * s for i, s in zip(held, way, strict=True)) - expected)), strict=True):
            p[i] = s


def _flight(units: DataFrame, level: int) -> DataFrame:
    """One round over ``units`` (rank, bucket, buckets, h, doc_id, size, k, whole, p); p comes back as 0, 1 or open."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        rank, bucket, buckets = (table.column(c)[0].as_py() for c in ("rank", "bucket", "buckets"))
        p = table.column("p").to_pylist()
        draws = np.random.default_rng([SEED, level, rank, bucket]).random(2 * len(p) + 3).tolist()
        settle(table.column("mass").to_pylist(), p, draws, buckets == 1)
        table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
        return table.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        of = None
        for batch in batches:
            ranks, buckets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((ranks[1:] != ranks[:-1]) | (buckets[1:] != buckets[:-1])) + 1).tolist(), len(ranks)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j == i:
                    continue
                if held and of != (ranks[i], buckets[i]):
                    yield finish(pa.Table.from_batches(held))
                    held = []
                of = (ranks[i], buckets[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield finish(pa.Table.from_batches(held))

    dealt = units.repartition("rank", "bucket").sortWithinPartitions("rank", "bucket", F.desc("mass"), "h", "doc_id")
    return dealt.mapInArrow(run, dealt.schema)


def copies(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, h, size, k equal rows, rank, copies; sources: source, n, source_size, rank, target)."""
    expose_package(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), identity(id_column, text_column, source_column).alias("h"), words(text_column).alias("size")
    )
    units = scratch.write(rows.groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("k")))
    sizes = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("k")).alias("source_size"))
    sources = scratch.write(targets(scratch, sizes).withColumnRenamed("source", "of_source"))
    many = sources.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.join(broadcast_if_small(sources, many), F.col("source").eqNullSafe(F.col("of_source")))
    part = F.col("rate") - F.floor("rate")
    open_ = joined.withColumn("rate", rate).select(
        "rank", F.lit(0).cast("long").alias("bucket"), F.col("n").alias("buckets"), "h", "doc_id", "size", "k", (F.col("size") * F.col("k")).cast("double").alias("mass"),
        (F.floor("rate") + F.when(part >= 1 - EDGE, 1).otherwise(0)).cast("long").alias("whole"),
        F.when((part <= EDGE) | (part >= 1 - EDGE), 0.0).otherwise(part).alias("p"),
    )
    done = open_.filter("p = 0")
    open_ = open_.filter("p > 0")
    level = 0
    while True:
        level += 1
        into = F.ceil(F.col("buckets") / F.lit(BUCKET)).cast("long")
        flown = scratch.write(_flight(open_.withColumn("buckets", into).withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(level)), F.col("buckets"))), level))
        done = done.union(flown.filter("p = 0 OR p = 1"))
        open_ = flown.filter("p > 0 AND p < 1")
        if open_.isEmpty():
            break
        counts = open_.groupBy("rank").agg(F.count(F.lit(1)).alias("left"))
        open_ = open_.join(broadcast_if_small(counts, many), "rank").withColumn("buckets", F.col("left")).drop("left")
        open_ = open_.select(done.columns)
    return done.select("doc_id", "h", "size", "k", "rank", (F.col("whole") + F.col("p").cast("long")).alias("copies")), sources.withColumnRenamed("of_source", "source")


def identity(id_column: str, text_column: str, source_column: str) -> Column:
    """A hash that equal documents share; nulls count as values."""
    parts = [x for c in (id_column, source_column, text_column) for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target (its source's), taken (words that the mix takes of it)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    chosen, sources = copies(docs, scratch, id_column, text_column, source_column)
    out = chosen.join(broadcast_if_small(sources, sources.count()), "rank")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    return out.select(F.col("doc_id").alias(id_column), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    scratch = Scratch(docs.sparkSession, "mixing")
    chosen, _ = copies(docs, scratch, id_column, text_column, source_column)
    own, h, doc, copies_, copy = (unused(docs, c) for c in ("own_hash", "taken_hash", "taken_id", "taken_copies", "taken_copy"))
    chosen = chosen.filter("copies > 0").select(F.col("h").alias(h), F.col("doc_id").alias(doc), F.col("copies").alias(copies_))
    rows = docs.withColumn(own, identity(id_column, text_column, source_column))
    joined = rows.join(chosen.hint("shuffle_hash"), (F.col(own) == F.col(h)) & F.col(id_column).eqNullSafe(F.col(doc)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies_)))).select(*[F.col(c) for c in docs.columns])
