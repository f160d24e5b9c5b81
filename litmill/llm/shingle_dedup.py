"""Near-duplicate groups of the pipeline: Golay-code SimHash over sets of five-word shingles, verified by similarity.

As in ``simhash``, with settings for a Jaccard similarity of ``SIMILARITY`` instead of four bits. Each set has
``WORDS`` fingerprints of 64 bits from independent hashes of its shingles. Two fingerprints share a key if two of their
three segments come near enough to a common codeword; where sets of similarity s differ in a share acos(2s / (1 + s)) / pi
of the bits, two words find 92 % of pairs of similarity 0.8, 97 % at 0.85 and 99 % at 0.9. Pairs of a key within ``BITS`` of
all bits are candidates (less than half a percent of similar pairs lie beyond), and components of these are candidate
groups, whose sets are read again and compared exactly.

A candidate group is not paired with itself: its sets meet the set of the most copies, and only those that are not
connected to it meet the others, in blocks of ``BLOCK`` sets, so that a group of close copies costs its size. What a
task keeps of the links it finds is a forest. Equal sets are one node. Empty and null texts have no shingles and are
equal; a text of fewer than five words is one shingle; texts are read whole; ids must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import BROADCAST_KEYS, Scratch, components, expose_package, keys_to_join, release, slices
from litmill.llm.simhash import SLICE_BYTES, forest, hamming_links, majority, names, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
WORDS, BITS = 2, 31
BLOCK = 1024


def _remixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes that are independent of those of other words."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(ids, sets of shingle hashes in order, their sizes, a hash of each) of rows (id, text)."""
    from xxhash import xxh64_intdigest

    release()
    for batch in batches:
        text = pc.fill_null(pc.cast(batch.column(1), pa.binary()), b"")
        for i, j in slices(text, SLICE_BYTES):
            sets = [np.unique(np.array(shingle_hashes(t, WIDTH), np.uint64)) for t in text.slice(i, j - i).to_pylist()]
            node = np.array([xxh64_intdigest(s.tobytes(), 0) for s in sets], np.uint64).view(np.int64)
            yield batch.column(0).slice(i, j - i), sets, np.fromiter(map(len, sets), np.int32, len(sets)), node


def wide_fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (id, node: a hash of the set, n: its size, fp: the name of its fingerprint, word0 ...) of every row of ``docs``."""
    fields = [f"word{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, sizes, node in _sets(batches):
            hashes = np.concatenate(sets)
            fp = np.stack([majority(_remixed(hashes, word), sizes.astype(np.int64)) for word in range(WORDS)], axis=1)
            columns = [pa.array(x) for x in (node, sizes, names(fp), *np.ascontiguousarray(fp.T).view(np.int64))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "node", "n", "fp", *fields])

    expose_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, node long, n int, fp long, {', '.join(f'{x} long' for x in fields)}")


def shingle_sets(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (node, shingles: the hashes of the set in order) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, sizes, node in _sets(batches):
            offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
            shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), shingles], ["node", "shingles"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "node long, shingles array<long>")


def similar_pairs(node: np.ndarray, offsets: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the similar pairs of sets. A set is compared with all others; those that are not in the largest
    group so far come next, until none is left: pairs within that group needn't be compared."""
    n, size = len(node), np.diff(offsets)
    _, token = np.unique(shingles, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    posting, start = owner[np.argsort(token, kind="stable")], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(token))))
    label, done = np.arange(n), np.zeros(n, bool)
    left, right = [], []
    i = 0
    while True:
        own = token[offsets[i] : offsets[i + 1]]
        many = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(posting[at], minlength=n)
        near = np.flatnonzero((common * (1 + SIMILARITY) >= SIMILARITY * (size[i] + size) - 1e-9) & (label != label[i]))
        left.append(np.full(len(near), node[i]))
        right.append(node[near])
        label[np.isin(label, label[near])] = label[i]
        done[i] = True
        left_over = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
        if not len(left_over):
            break
        i = int(left_over[0])
    a, b = np.concatenate(left), np.concatenate(right)
    return forest(a, b) if len(a) else (a, b)


def link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (group, node, shingles) that come sorted by group."""

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        shingles = rows.column("shingles").combine_chunks()
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.list_value_length(shingles).to_numpy())))
        a, b = similar_pairs(rows.column("node").to_numpy(), offsets, pc.list_flatten(shingles).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    release()
    held, last = [], None
    for batch in batches:
        group = batch.column(0).to_numpy()
        ends = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if j > i:
                if held and group[i] != last:
                    yield linked(held)
                    held = []
                last = group[i]
                held.append(batch.slice(i, j - i))
    if held:
        yield linked(held)


def _linked(scratch: Scratch, sets: DataFrame, dealt: DataFrame) -> DataFrame:
    """Links of rows (group, lead, node), the lead of a group first."""
    rows = dealt.join(sets, "node").repartition("group").sortWithinPartitions("group", F.desc("lead")).select("group", "node", "shingles")
    return scratch.write(rows.mapInArrow(link_groups, "a long, b long"))


def similar_links(scratch: Scratch, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs within candidate groups (root, node, copies)."""
    lead = F.max(F.struct("copies", "node")).getField("node")
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    groups = scratch.write(members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), lead.alias("lead")).withColumn("blocks", parts(F.col("n"))))
    blocked = members.join(groups, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    group = lambda *more: F.xxhash64("root", "block", *more).alias("group")
    own = blocked.select(group(), (F.col("node") == F.col("lead")).alias("lead"), "node")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    leads = groups.filter("blocks > 1").select("root", F.col("lead").alias("node"), every, "blocks").filter(F.pmod(F.xxhash64("node"), F.col("blocks")) != F.col("block"))
    first = _linked(scratch, sets, own.union(leads.select(group(), F.lit(True).alias("lead"), "node")))
    many = blocked.filter("blocks > 1")
    if many.isEmpty():
        return first
    roots = components(scratch, first).withColumnRenamed("root", "part")
    placed = many.join(roots, "node", "left").select("root", "node", "lead", "block", "blocks", F.coalesce("part", "node").alias("part"))
    of_lead = placed.filter("node = lead").select("root", F.col("part").alias("main"))
    rest = scratch.write(placed.join(of_lead, "root").filter("part <> main").select("root", "node", "blocks"))
    chunks = rest.groupBy("root").agg(parts(F.count(F.lit(1))).alias("chunks"))
    asked = rest.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")).select("root", "node", "chunk", every)
    asked = asked.select(group("chunk"), "node")
    others = placed.join(chunks, "root").select("root", "node", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(group("chunk"), "node")
    more = _linked(scratch, sets, asked.union(others).distinct().select("group", F.lit(False).alias("lead"), "node"))
    return first.union(more)


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id, component_id (the smallest id reachable)."""
    scratch = Scratch(docs.sparkSession, "shingles")
    words = [f"word{i}" for i in range(WORDS)]
    rows = scratch.write(wide_fingerprints(docs, id_column, text_column))
    values = rows.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in ("n", "fp", *words)])
    values = scratch.write(values)
    prints = values.filter("n > 0").groupBy("fp").agg(*[F.min(c).alias(c) for c in words], F.count(F.lit(1)).alias("sets"))
    prints = scratch.write(prints)
    near = scratch.write(components(scratch, hamming_links(scratch, prints.select(*words), BITS)))
    candidates = prints.join(keys_to_join(near.withColumnRenamed("node", "fp"), BROADCAST_KEYS // 2), "fp", "left").filter("sets > 1 OR root IS NOT NULL")
    candidates = scratch.write(candidates.select("fp", F.coalesce("root", "fp").alias("root")))
    members = values.filter("n > 0").join(keys_to_join(candidates, BROADCAST_KEYS // 2), "fp").select("root", "node", "copies", "least")
    members = scratch.write(members)
    asked = docs.join(keys_to_join(members.select(F.col("least").alias(id_column))), id_column, "left_semi")
    sets = scratch.write(shingle_sets(asked, id_column, text_column))
    if sets.count() > members.count():  # an id occurs more than once
        sets = scratch.write(sets.dropDuplicates(["node"]))
    roots = components(scratch, similar_links(scratch, members.select("root", "node", "copies"), sets))
    scratch.drop(sets)
    grouped = values.join(roots, "node", "left").filter("copies > 1 OR root IS NOT NULL")
    grouped = scratch.write(grouped.select("node", "least", F.coalesce("root", "node").alias("root")))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.write(grouped.join(named, "root").select("node", "component_id"))  # of those that aren't alone
    scratch.keep_only(rows, named)
    out = rows.select("id", "node").join(keys_to_join(named, BROADCAST_KEYS // 2), "node", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("component_id", "id").alias("component_id"))
