"""Operator 9: near-duplicate groups by 64-bit SimHash, with links found through Golay-code keys.

Fingerprints are cut into segments of 23, 23 and 18 bits. Of at most four differing bits, the two segments with the
fewest hold two at most together, so each of them holds two at most. Two words of 23 bits that differ in two places
share a word one flip away from both; the perfect Golay code decodes it to one codeword. So when a segment gives the
codewords of its word and of all words one flip away (six keys or one), two segments within two bits always share a
key, and the keys of a pair of segments lose no link. Rows are grouped by those keys, verified on all 64 bits, and
linked groups are closed to components.

Equal fingerprints are one node. What a task keeps of the links it verified is a spanning forest. A key whose group
is larger than ``GROUP`` goes to a second step that deals pairs of blocks to different tasks, with no link lost.

Nulls in the text count as empty text, whose fingerprint is zero; a null id is carried along and never names a
component, unless it has no other member; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import BROADCAST_KEYS, Scratch, components, expose_package, keys_to_join, release, row_key, slices, unused

SLICE_BYTES = 2 << 20
#: Members that one key's group may have within one task.
GROUP = 8192
#: Verified links a task holds before it reduces them to a forest.
HELD = 400_000
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_BITS = 4
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the binary Golay code


# Fingerprints


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``width`` words of an ASCII-lower-cased text, or of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(text.lower().split())
    if not joined:
        return []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][min(width, len(starts)) - 1 :]
    return [xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts, ends, strict=False)]


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is set if it is in over half of them; zero for empty runs.

    Eight byte-wide counters share a 64-bit word, so runs are summed in blocks of 255 and the blocks are widened."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    size = lengths[full]
    blocks = -(-size // 255)
    first_block = np.cumsum(blocks) - blocks
    start = np.cumsum(size) - size
    inner = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    block_start = np.repeat(start, blocks) + 255 * inner
    ones = np.uint64(0x0101010101010101)
    votes = np.empty((len(full), 8, 8), np.int64)  # byte, bit
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ones, block_start)
        votes[:, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
    bits = (2 * votes > size[:, None, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=2, bitorder="little").reshape(-1, 8).copy().view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fp: the fingerprint as a signed long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            text = pc.fill_null(pc.cast(batch.column(1), pa.binary()), b"")
            parts = []
            for i, j in slices(text, SLICE_BYTES):
                each = [shingle_hashes(t, width) for t in text.slice(i, j - i).to_pylist()]
                lengths = np.fromiter(map(len, each), np.int64, len(each))
                hashes = np.fromiter((h for hs in each for h in hs), np.uint64, int(lengths.sum()))
                parts.append(majority(hashes, lengths))
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    expose_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# Golay keys


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [syndrome(1 << bit) for bit in range(23)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for bit in range(12):
        low[np.arange(1 << 12) >> bit & 1 == 1] ^= unit[bit]
    for bit in range(11):
        high[np.arange(1 << 11) >> bit & 1 == 1] ^= unit[12 + bit]
    error = np.zeros(1 << 11, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error[np.bitwise_xor.reduce([unit[b] for b in bits])] = sum(1 << b for b in bits)
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, error = _golay()
    words = words.astype(np.int32)
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Per word up to six codeword indices, of itself and of all words one flip away within ``bits``; -1 fills."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
    near = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out = np.full((len(words), 6), -1, np.int64)
    row, column = np.nonzero(new)
    out[row, place[row, column]] = near[row, column]
    return out


def golay_keys(fp: np.ndarray, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints: (the index of the fingerprint, key); those of different kinds never meet."""
    each = [segment_keys(((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64), bits) for at, bits in SEGMENTS]
    owners, keys = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        key = ((3 * kind + n) << 24) + (each[i][:, :, None] << 12) + each[j][:, None, :]
        valid = (each[i][:, :, None] >= 0) & (each[j][:, None, :] >= 0)
        owners.append(np.nonzero(valid)[0])
        keys.append(key[valid])
    return np.concatenate(owners), np.concatenate(keys)


# Links within sorted groups


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of every component of the links: (member, smallest member), without the smallest itself."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        np.minimum.at(label, before[left], least)
        np.minimum.at(label, before[right], least)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def names(values: np.ndarray) -> np.ndarray:
    """What fingerprints of one or more 64-bit words (rows) are called as nodes: the word itself, or a hash."""
    with np.errstate(over="ignore"):
        out = values[:, 0].copy()
        for word in values.T[1:]:
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return out.view(np.int64)


class Linker:
    """Takes runs of (group, value) in the groups' order and yields what is within ``bits`` bits, as a forest."""

    def __init__(self, bits: int):
        self.bits = bits
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.held = 0

    def pairs(self, group: np.ndarray, value: np.ndarray) -> None:
        """Complete groups: every pair within a group is compared, one distance in the order after the other."""
        at, step = np.arange(len(group)), 1
        while True:
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(value[at] ^ value[at + step]).sum(axis=1, dtype=np.int64) <= self.bits]
            if len(near):
                self.left.append(names(value[near]))
                self.right.append(names(value[near + step]))
                self.held += len(near)
                if self.held > HELD:
                    self.reduce()
            step += 1

    def reduce(self) -> None:
        if self.held:
            a, b = forest(np.concatenate(self.left), np.concatenate(self.right))
            self.left, self.right, self.held = [a], [b], len(a)

    def take(self, words: int) -> pa.RecordBatch:
        self.reduce()
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.left, self.right))
        self.left, self.right, self.held = [], [], 0
        return _links(a, b, np.full(len(a), -1), np.zeros((len(a), words), np.uint64))


def _links(a: np.ndarray, b: np.ndarray, block: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    columns = [a, b, block, *value.view(np.int64).T]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in columns], ["a", "b", "block", *_words(value.shape[1])])


def _words(n: int) -> list[str]:
    return [f"word{i}" for i in range(n)]


def link_sorted(batches: Iterator[pa.RecordBatch], bits: int, limit: int | None, words: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b, -1) of rows (group, value ...) that come sorted by group. A group of over ``limit`` rows is not
    compared: its rows come out as (group, 0, block, value ...) for the second step."""
    release()
    linker = Linker(bits)
    group, value = np.zeros(0, np.int64), np.zeros((0, words), np.uint64)
    large, seen = None, 0  # the group that is being passed on, and how many of its rows have gone

    def passed(group: np.ndarray, value: np.ndarray, first: int) -> pa.RecordBatch:
        return _links(group, np.zeros(len(group), np.int64), (first + np.arange(len(group))) // limit, value)

    for batch in batches:
        new_group = batch.column(0).to_numpy()
        new_value = np.stack([batch.column(1 + i).to_numpy().view(np.uint64) for i in range(words)], axis=1)
        if large is not None:
            n = int(np.searchsorted(new_group != large, True)) if (new_group != large).any() else len(new_group)
            if n:
                yield passed(new_group[:n], new_value[:n], seen)
                seen += n
            new_group, new_value = new_group[n:], new_value[n:]
            if not len(new_group):
                continue
            large = None
        group, value = np.concatenate((group, new_group)), np.concatenate((value, new_value))
        if not len(group):
            continue
        last = int(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[-1])
        done_group, done_value, group, value = group[:last], value[:last], group[last:], value[last:]
        if limit is not None and last:  # a large group may end within this batch
            _, start, size = np.unique(done_group, return_index=True, return_counts=True)
            for i, n in zip(start[size > limit], size[size > limit], strict=True):
                yield passed(done_group[i : i + n], done_value[i : i + n], 0)
            if (size > limit).any():
                small = np.repeat((size <= limit)[np.argsort(np.argsort(start))], size[np.argsort(start)])
                done_group, done_value = done_group[small], done_value[small]
        linker.pairs(done_group, done_value)
        if limit is not None and len(group) > limit:
            large, seen = int(group[0]), len(group)
            yield passed(group, value, 0)
            group, value = group[:0], value[:0]
        if linker.held > HELD:
            linker.reduce()
            if linker.held > HELD:
                yield linker.take(words)
    linker.pairs(group, value)
    yield linker.take(words)


def hamming_links(scratch: Scratch, values: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the ``names`` of fingerprints, whose columns are their 64-bit words: their components are
    those of all pairs within ``bits`` bits that share a key of one word. Within four bits of one word all pairs do."""
    words = len(values.columns)
    fields = [f"word{i}" for i in range(words)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fp = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns], axis=1)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                for kind in range(words):
                    owner, key = golay_keys(part[:, kind], kind)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(x[owner].view(np.int64)) for x in np.ascontiguousarray(part.T))], ["key", *fields])

    schema = ", ".join(f"{x} long" for x in fields)
    linked = f"a long, b long, block long, {schema}"
    keyed = values.mapInArrow(emit, f"key long, {schema}")
    near = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: link_sorted(b, bits, GROUP, words), linked)
    near = scratch.write(near)
    large = near.filter("block >= 0").select(F.col("a").alias("key"), "block", *fields)
    links = near.filter("block < 0").select("a", "b")
    if large.isEmpty():
        return links
    blocks = large.groupBy("key").agg((F.max("block") + 1).alias("n"))
    pairs = large.join(blocks, "key").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"), "key", "block", *fields)
    dealt = pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), *fields)
    more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: link_sorted(b, bits, None, words), linked)
    return links.union(scratch.write(more).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, width, id_column, text_column))
    values = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(scratch, hamming_links(scratch, values.select("fp")))
    grouped = values.join(roots, F.col("fp") == F.col("node"), "left").filter("n > 1 OR root IS NOT NULL")
    grouped = scratch.write(grouped.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_value = scratch.write(grouped.join(named, "root").select("fp", "component_id"))  # of those that aren't alone
    scratch.keep_only(rows, of_value)
    return rows.join(keys_to_join(of_value, BROADCAST_KEYS // 2), "fp", "left").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame, str, str], DataFrame], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, without the near duplicates: of each component that ``grouped``
    gives for (docs, id, text) one row stays.

    Rows are told apart by a hash of id and text, so null and repeated ids do no harm; the row of the smallest hash
    stays. Rows of equal id and text are left as one."""
    key = unused(docs, "row_key")
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    groups = Scratch(docs.sparkSession, "keep").write(grouped(keyed, key, text_column).select(F.col(key).alias("key"), "component_id"))
    repeated = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    repeated = repeated.join(groups.filter("key = component_id").select("key").distinct(), "key", "left_semi").withColumnRenamed("key", key)
    gone = groups.filter("key <> component_id").select(F.col("key").alias(key)).union(repeated).distinct()
    left = keyed.join(keys_to_join(gone), key, "left_anti")
    if not repeated.isEmpty():
        left = left.unionByName(keyed.join(keys_to_join(repeated), key, "left_semi").dropDuplicates([key]))
    return left.select(*[F.col(c) for c in docs.columns])
