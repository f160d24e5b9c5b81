"""Operator 2: near-duplicate vectors by range search on a robust-pruned flat graph.

Equal vectors of a label are one node with a weight. Nodes of a label are split among centres, level by level, until no
group has over ``SHARD`` nodes; on each level a node goes to its nearest centre, and a copy of it to the next nearest, so
shards overlap. Centres are fitted for each group on a bounded sample (``SAMPLE_PER_CENTRE`` nodes for each of at most
``FAN_OUT`` centres). Every shard builds adjacency lists by robust pruning, and a node's lists from all its shards are
united. Then every node is searched in the shard of its nearest centres, together with all nodes that the united lists of
the shard lead to: a greedy beam search starts from the medoid, and from all nodes near the query found on the way the
search expands along the united lists, also across shards, as long as it stays in range. Links are verified by cosine in
double precision.

A group whose nodes are as near to each other as links ask for isn't split: there most pairs are links and have to be
counted, so pairs of blocks of ``BLOCK`` nodes are compared exactly, each in a task of its own.

``audit`` compares queries with brute force over all nodes, half of them nodes with links found, half any. If the recall is
below ``RECALL`` the search is repeated with a wider beam; if it stays below ``LEAST_RECALL`` all groups are compared
exactly. The recall is logged and part of ``search``'s result.

Only vectors of equal, known labels and equal length are compared. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing and are kept; so are those without label. Rows of equal id and different
vectors are different nodes; columns other than the three named are left out, so no name can clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Scratch, broadcast_if_small, components, expose_package
from litmill.llm.simhash import forest

LOG = logging.getLogger(__name__)
SHARD, BLOCK = 1000, 2048
FAN_OUT, SAMPLE_PER_CENTRE, LEVELS = 64, 16, 12
#: How far below the threshold the mean cosine of a group's pairs may be for it to be compared exactly.
TIGHT = 0.02
DEGREE, CANDIDATES, FAR, BACK, FAN, ALPHA = 24, 48, 16, 40, 8, 1.2
BEAM, SLACK, RECALL, LEAST_RECALL, AUDITED = 24, 0.04, 0.95, 0.9, 512


# One shard


def robust_prune(v: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists: a candidate is taken, nearest first, unless one taken before is closer to it by the factor
    ``ALPHA`` than the node is. Candidates are the nearest nodes and then some from anywhere, with places of their
    own, which keep dense groups within reach. Links go both ways; of those that come back a node keeps the nearest ``BACK``, which
    hand on the others as a tree, so that the middle of a dense group still leads to all of it."""
    m = len(v)
    if m == 1:
        return [np.zeros(0, np.int64)]
    k = min(CANDIDATES, m - 1)
    far = np.random.default_rng(m).integers(0, m, (m, FAR))
    near = np.empty((m, k + FAR), np.int64)
    for i in range(0, m, 1024):
        sims = v[i : i + 1024] @ v.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        part = np.argpartition(sims, -k, axis=1)[:, -k:]
        near[i : i + len(sims), :k] = np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
        part = far[i : i + 1024]
        near[i : i + len(sims), k:] = np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    lists = np.full((m, DEGREE + FAR // 2), -1)
    for i in range(0, m, 512):
        rows, own, mine = near[i : i + 512], v[i : i + 512], lists[i : i + 512]
        taken = np.zeros(len(rows), np.int64)
        for j in range(rows.shape[1]):
            c = rows[:, j]
            to_node = 1 - np.einsum("nd,nd->n", own, v[c])
            to_taken = 1 - np.einsum("nd,nrd->nr", v[c], v[mine])
            to_taken[mine < 0] = np.inf
            at = np.flatnonzero((taken < (DEGREE if j < k else DEGREE + FAR // 2)) & (ALPHA * to_taken.min(axis=1) > to_node) & (c != np.arange(i, i + len(rows))))
            mine[at, taken[at]] = c[at]
            taken[at] += 1
    start, end = np.repeat(np.arange(m), lists.shape[1]), lists.ravel()
    start, end = start[end >= 0], end[end >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", v[start], v[end]), end))
    back_of, back = end[order], start[order]
    first = np.searchsorted(back_of, back_of)
    place = np.arange(len(back_of)) - first
    more = np.flatnonzero(place >= BACK)
    parent = back[first[more] + (place[more] - BACK) // FAN]
    both = np.unique(np.concatenate((start * m + end, back_of[place < BACK] * m + back[place < BACK], parent * m + back[more])))
    return np.split(both % m, np.searchsorted(both // m, np.arange(1, m)))


def exact_search(v: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of cosine ``threshold`` and over."""
    out_q, out_n = [], []
    for i in range(0, len(queries), 512):
        q = queries[i : i + 512]
        a, b = np.nonzero(v[q] @ v.T >= threshold)
        other = q[a] != b
        out_q.append(q[a][other])
        out_n.append(b[other])
    return (np.concatenate(out_q), np.concatenate(out_n)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def range_search(v: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of cosine ``threshold`` and over, found from the medoid along ``lists``."""
    m = len(v)
    width = max(1, max(map(len, lists)))
    adjacent = np.stack([np.concatenate((x, np.full(width - len(x), i))) for i, x in enumerate(lists)]).astype(np.int64)
    middle = v.mean(axis=0)
    medoid = int(np.argmax(v @ middle))
    out_q, out_n = [], []
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        n = len(q)
        seen = np.zeros((n, m), bool)
        seen[:, medoid] = True
        ids, sims = np.full((n, beam), medoid), np.full((n, beam), -2.0)
        sims[:, 0] = v[q] @ v[medoid]
        done = np.ones((n, beam), bool)
        done[:, 0] = False
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.arange(n), np.full(n, medoid), sims[:, 0].copy())]
        active = np.arange(n)
        while len(active):
            best = np.where(done[active], -3.0, sims[active]).argmax(axis=1)
            going = ~done[active, best]
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            around = adjacent[ids[active, best]]
            new = ~seen[active[:, None], around]
            s = np.where(new, np.einsum("nd,nrd->nr", v[q[active]], v[around]), -2.0)
            seen[active[:, None], around] = True
            row, column = np.nonzero(new & (s >= threshold - SLACK))
            near.append((active[row], around[row, column], s[row, column]))
            all_ids, all_sims = np.concatenate((ids[active], around), 1), np.concatenate((sims[active], s), 1)
            all_done = np.concatenate((done[active], ~new), 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        row, node, sim = (np.concatenate(x) for x in zip(*near, strict=True))
        keep = sim >= threshold - SLACK
        row, node, sim = row[keep], node[keep], sim[keep]
        found = np.zeros((n, m), bool)
        while len(row):  # expand along the lists while in range
            hit = sim >= threshold
            found[row[hit], node[hit]] = True
            pairs = []
            for a in range(0, len(row), 4096):
                around = adjacent[node[a : a + 4096]]
                r = np.repeat(row[a : a + 4096], around.shape[1])
                flat = around.ravel()
                new = ~seen[r, flat]
                key = np.unique(r[new] * m + flat[new])
                r, flat = key // m, key % m
                seen[r, flat] = True
                s = np.einsum("nd,nd->n", v[q[r]], v[flat])
                close = s >= threshold - SLACK
                pairs.append((r[close], flat[close], s[close]))
            row, node, sim = (np.concatenate(x) for x in zip(*pairs, strict=True))
        a, b = np.nonzero(found)
        other = q[a] != b
        out_q.append(q[a][other])
        out_n.append(b[other])
    return (np.concatenate(out_q), np.concatenate(out_n)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of lists of equal length."""
    v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal shard from batches that come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and held[-1].column(0)[0].as_py() != shard[i]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# All shards


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Rows (label, dim, embedding, node, weight, least) of different valid vectors of (id, embedding, label)."""
    valid = "label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    return (
        vectors.filter(valid).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
        .withColumn("dim", F.size("embedding")).withColumn("node", F.xxhash64("label", "embedding"))
    )


def centres_of(v: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres of unit vectors by rounds of nearest centres and means."""
    centres = v[:: max(1, len(v) // k)][:k].copy()
    for _ in range(8):
        own = (v @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = v[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def _centres(members: DataFrame, sizes: DataFrame, threshold: float, level: int) -> DataFrame:
    """Rows (group, centre, vector) of the groups (group, n) that are to be split."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            v, n = _vectors(table.column("embedding").combine_chunks()), table.column("n")[0].as_py()
            mean = v.mean(axis=0)
            if float(mean @ mean) >= threshold - TIGHT or len(v) < 2:  # the mean cosine of all pairs
                continue
            found = centres_of(v, max(2, min(FAN_OUT, -(-2 * n // SHARD), len(v))))
            group = [table.column("group")[0].as_py()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["group", "centre", "vector"])

    asked = F.least(F.lit(FAN_OUT), F.ceil(2 * F.col("n") / F.lit(SHARD))) * SAMPLE_PER_CENTRE
    sample = members.join(sizes, "group").filter(F.pmod(F.xxhash64("node", F.lit(level)), F.col("n")) < asked)
    rows = sample.select("group", "node", "embedding", "n").repartition("group").sortWithinPartitions("group", "node").select("group", "embedding", "n")
    return rows.mapInArrow(fit, "group long, centre long, vector array<double>")


def _assigned(members: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members`` (group, node, embedding, query) in the groups of their nearest centres. Centres come first in every
    part of a group, of which there are as many as its size asks for."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            member = table.column("member").to_numpy(zero_copy_only=False)
            known, rows = table.filter(pa.array(~member)), table.filter(pa.array(member))
            c, v = _vectors(known.column("vector").combine_chunks()), _vectors(rows.column("embedding").combine_chunks())
            sims = v @ c.T
            first = sims.argmax(axis=1)
            sims[np.arange(len(v)), first] = -2
            second = sims.argmax(axis=1)
            also = np.flatnonzero(rows.column("query").to_numpy(zero_copy_only=False))
            at = pa.array(np.concatenate((np.arange(len(v)), also)))
            to = np.concatenate((first, second[also]))
            query = np.concatenate((rows.column("query").to_numpy(zero_copy_only=False), np.zeros(len(also), bool)))
            columns = [rows.column(x).combine_chunks().take(at) for x in ("group", "node", "embedding")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(to, pa.int64()), pa.array(query)], ["group", "node", "embedding", "centre", "query"])

    kind = dict(members.dtypes)["embedding"]
    parts = F.ceil(F.col("n") / F.lit(8 * SHARD)).cast("int")
    part = lambda x: F.xxhash64("group", x).alias("part")
    of_member = members.join(sizes, "group").select(part(F.pmod(F.xxhash64("node"), parts).cast("int")), F.lit(True).alias("member"), "group", "node", "embedding", "query", F.lit(None).cast("array<double>").alias("vector"))
    of_centre = centres.join(sizes, "group").withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
    of_centre = of_centre.select(part(F.col("i")), F.lit(False), "group", F.col("centre"), F.lit(None).cast(kind), F.lit(False), "vector")
    rows = of_member.union(of_centre).repartition("part").sortWithinPartitions("part", "member", "node")
    split = rows.mapInArrow(assign, f"group long, node long, embedding {kind}, centre long, query boolean")
    return split.select(F.xxhash64("group", "centre").alias("group"), "node", "embedding", "query")


def shards_of(scratch: Scratch, nodes: DataFrame, threshold: float, split: bool = True) -> DataFrame:
    """Rows (shard, node, embedding, query, side, exact): ``query`` where the node is searched. Groups that are not split
    further and have over ``BLOCK`` nodes are dealt by pairs of blocks (``exact``), in which only nodes of the other
    ``side`` count, if there is one."""
    members = nodes.select(F.xxhash64("label", "dim").alias("group"), "node", "embedding", F.lit(True).alias("query"))
    done: list[DataFrame] = []
    for level in range(LEVELS if split else 0):
        sizes = scratch.write(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
        large = sizes.filter(F.col("n") > SHARD)
        centres = scratch.write(_centres(members, large, threshold, level))
        if centres.isEmpty():
            break
        going = centres.select("group").distinct()
        done.append(members.join(going, "group", "left_anti"))
        members = scratch.write(_assigned(members.join(going, "group", "left_semi"), centres, large))
    for part in done:
        members = members.unionByName(part)
    members = scratch.write(members)
    sizes = scratch.write(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
    joined = members.join(broadcast_if_small(sizes, sizes.count()), "group")
    exact = F.col("n") > BLOCK if split else F.lit(True)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), blocks)
    dealt = joined.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.select(
        F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("shard"), "node", "embedding", "query",
        F.when(F.col("block") != F.col("other"), (F.col("block") > F.col("other")).cast("int")).alias("side"), exact.alias("exact"),
    )


def _graph(shards: DataFrame) -> DataFrame:
    """United adjacency lists (node, list) of the nodes in shards that are searched along them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            ids = table.column("node").to_numpy()
            lists = robust_prune(_vectors(table.column("embedding").combine_chunks()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[x].tolist() for x in lists], pa.list_(pa.int64()))], ["node", "list"])

    sorted_ = shards.filter("NOT exact").select("shard", "node", "embedding").repartition("shard").sortWithinPartitions("shard", "node")
    return sorted_.mapInArrow(build, "node long, list array<long>").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"))


def _within_reach(scratch: Scratch, shards: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """``shards`` with lists and weights, and for every shard the nodes outside that the united lists of its queries lead to."""
    own = shards.filter("NOT exact")
    led = own.filter("query").select("shard", "node").join(graph, "node").select("shard", F.explode("list").alias("node")).distinct()
    outside = led.join(own.select("shard", "node"), ["shard", "node"], "left_anti").join(nodes.select("node", "embedding"), "node")
    outside = outside.select("shard", "node", "embedding", F.lit(False).alias("query"), F.lit(None).cast("int").alias("side"), F.lit(False).alias("exact"))
    return scratch.write(shards.unionByName(outside).join(graph, "node", "left").join(nodes.select("node", "weight"), "node"))


def _search(shards: DataFrame, threshold: float, beam: int) -> DataFrame:
    """Rows (a, b, n): b null and n the weight that a links to in a shard; or links (a, b) of a shard's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            ids = table.column("node").to_numpy()
            v = _vectors(table.column("embedding").combine_chunks())
            queries = np.flatnonzero(table.column("query").to_numpy(zero_copy_only=False))
            if table.column("exact")[0].as_py():
                a, b = exact_search(v, queries, threshold)
                side = table.column("side").to_numpy(zero_copy_only=False)
                if table.column("side")[0].is_valid:
                    a, b = (x[side[a] != side[b]] for x in (a, b))
            else:
                place = {x: i for i, x in enumerate(ids.tolist())}
                lists = [np.array([place[x] for x in near or [] if x in place], np.int64) for near in table.column("list").to_pylist()]
                a, b = range_search(v, lists, queries, threshold, beam)
            counted = np.bincount(a, table.column("weight").to_numpy()[b], len(ids)).astype(np.int64)
            some = np.flatnonzero(counted)
            x, y = forest(ids[a], ids[b]) if len(a) else (ids[:0], ids[:0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((ids[some], x))), pa.array([None] * len(some) + y.tolist(), pa.int64()), pa.array(np.concatenate((counted[some], np.zeros(len(x), np.int64))))], ["a", "b", "n"]
            )

    rows = shards.select("shard", "node", "embedding", "query", "side", "exact", "list", "weight")
    return rows.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "a long, b long, n long")


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, sample: int = AUDITED) -> float | None:
    """The share of the weight linked by brute force over all nodes to ``sample`` queries that was found: half of the
    queries are nodes with links found, half any, each those of the lowest hashes. None if they have no links."""
    order = F.xxhash64("node", F.lit(7))
    with_links = counted.orderBy(order).limit(sample // 2).select("node")
    ids = [r.node for r in with_links.union(nodes.orderBy(order).limit(sample - sample // 2).select("node")).distinct().collect()]
    asked = nodes.filter(F.col("node").isin(ids)).select("node", "label", "dim", "embedding").collect()
    if not asked:
        return None
    groups: dict[tuple, list] = {}
    for r in asked:
        groups.setdefault((r.label, r.dim), []).append(r)
    known = {k: (np.array([r.node for r in rs]), _vectors(pa.array([r.embedding for r in rs]))) for k, rs in groups.items()}
    sent = nodes.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            key = np.array([hash(k) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            for k, (ids, v) in sent.value.items():
                at = np.flatnonzero(key == hash(k))
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                near = v @ _vectors(part.column(2)).T >= threshold
                near &= ids[:, None] != part.column(3).to_numpy()[None, :]
                for i, n in zip(ids.tolist(), (near @ part.column(4).to_numpy()).tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "n"])

    exact = nodes.select("label", "dim", "embedding", "node", "weight").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    want = sum(r.n for r in exact)
    got = counted.filter(F.col("node").isin(ids)).agg(F.sum("linked")).first()[0] or 0
    return got / want if want else None


def search(scratch: Scratch, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, float | None]:
    """(rows (node, linked), links (a, b) whose components are those of all, measured recall)."""
    shards = scratch.write(shards_of(scratch, nodes, threshold))
    rows = _within_reach(scratch, shards, scratch.write(_graph(shards)), nodes)
    beam = BEAM
    while True:
        found = scratch.write(_search(rows, threshold, beam))
        counted = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "node")
        recall = audit(nodes, counted, threshold)
        LOG.info("recall %s with a beam of %d", recall, beam)
        if recall is None or recall >= RECALL or (beam >= 4 * BEAM and recall >= LEAST_RECALL):
            break
        if beam >= 4 * BEAM:  # nothing is returned below the least recall
            whole = shards_of(scratch, nodes, threshold, split=False)
            rows = scratch.write(whole.withColumn("list", F.lit(None).cast("array<long>")).join(nodes.select("node", "weight"), "node"))
            found = scratch.write(_search(rows, threshold, beam))
            counted = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "node")
            recall = 1.0
            break
        beam *= 2
    return counted, found.filter("b IS NOT NULL").select("a", "b"), recall


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    expose_package(spark)
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("embedding"), F.col(label_column).alias("label"))
    nodes = scratch.write(nodes_of(rows))
    counted, links, _ = search(scratch, nodes, threshold)
    roots = components(scratch, links)
    known = nodes.join(counted, "node", "left").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    known = scratch.write(known.select("node", "weight", "least", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root")))
    scratch.keep_only(known)
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").select("node", (F.col("weight") - 1 + F.col("linked")).alias("n_links"), "component")
    joined = rows.withColumn("node", F.xxhash64("label", "embedding")).select("id", "node").join(known, "node", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
