"""Topic models: word weights, coherence, density clusters, hierarchy and the parameter sweep.

Dimensions are reduced by PCA and clusters found by density on the reduced vectors; both stand in for the usual
non-linear methods, whose libraries this engine does without."""

from __future__ import annotations

import json
import math
import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.functions.arrays import cosine
from litmill.functions.text import ngrams, tokens
from litmill.operators.reports import top_per_group
from litmill.session import expose_package, written

NOISE = -1


@dataclass(frozen=True)
class TopicConfig:
    n_neighbors: int = 15
    n_components: int = 5
    min_cluster_size: int = 80
    min_samples: int | None = None
    nr_topics: int | str | None = None
    min_df: int = 10
    ngram: int = 2
    top_n: int = 10
    mid_target: int = 20
    top_target: int = 6
    seed: int = 42


# Words


def term_list(text: str, ngram: int = 1, stop_words: list[str] | None = None) -> Column:
    """All tokens of a text column and their runs up to ``ngram``."""
    words = tokens(F.col(text), stop_words)
    if ngram == 1:
        return words
    return F.transform(F.array(words), lambda w: F.flatten(F.array(*[ngrams(w, n) for n in range(1, ngram + 1)])))[0]


def terms(docs: DataFrame, key: str = "pmid", text: str = "text", ngram: int = 1, stop_words: list[str] | None = None) -> DataFrame:
    """Rows (key, term) of all tokens and their runs up to ``ngram``."""
    return docs.select(key, F.explode(term_list(text, ngram, stop_words)).alias("term"))


def class_weights(docs: DataFrame, topic: str = "topic_id", key: str = "pmid", text: str = "text", ngram: int = 1, min_df: int = 1, stop_words: list[str] | None = None) -> DataFrame:
    """Rows (topic, term, weight): a term's share of its class times log(1 + words per class / its count overall).
    ``min_df`` counts documents. The topic goes with every term, so only counts are shuffled."""
    counted = [F.count(F.lit(1)).cast("double").alias("tf")] + ([F.countDistinct(key).alias("df")] if min_df > 1 else [])
    rows = docs.select(topic, *([key] if min_df > 1 else []), F.explode(term_list(text, ngram, stop_words)).alias("term"))
    counts = rows.groupBy(topic, "term").agg(*counted)
    if min_df > 1:
        kept = counts.groupBy("term").agg(F.sum("df").alias("df")).filter(F.col("df") >= min_df).select("term")
        counts = counts.join(kept, "term")
    sizes = counts.groupBy(topic).agg(F.sum("tf").alias("words"))
    overall = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    average = sizes.agg(F.avg("words").alias("a"))  # one row
    joined = counts.join(sizes, topic).join(overall, "term").join(F.broadcast(average))
    return joined.select(topic, "term", (F.col("tf") / F.col("words") * F.log1p(F.col("a") / F.col("f"))).alias("weight"))


def top_words(weights: DataFrame, topic: str = "topic_id", n: int = 10, digits: int = 8) -> DataFrame:
    """Rows (topic, term, weight, rank)."""
    rounded = weights.withColumn("weight", F.round("weight", digits))
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("weight"), "term"))
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= n)


def word_lists(top: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Rows (topic, words in order of rank)."""
    return top.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term).alias("words"))


# Coherence


def _terms_of_windows(batches: Iterator[pa.RecordBatch], vocabulary: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Different sets of vocabulary words in the windows of token lists, with how many windows hold them. A word is in the
    windows that begin in a union of intervals; sets of bits flip where one begins or ends."""
    lanes = -(-len(vocabulary) // 63) or 1
    for lists in (b.column(0).slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        ends = np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
        term = pc.fill_null(pc.index_in(lists.flatten(), pa.array(vocabulary, lists.type.value_type)), -1).to_numpy(zero_copy_only=False)
        base = np.r_[0, ends[:-1]]
        last = np.maximum(ends - base - size + 1, 1)  # windows of each list
        at = np.flatnonzero(term >= 0)
        doc, term = np.searchsorted(ends, at, "right"), term[at].astype(np.int64)
        order = np.lexsort((at, term, doc))
        at, doc, term = at[order], doc[order], term[order]
        begin, end = np.maximum(at - size + 1, base[doc]), np.minimum(at + 1, base[doc] + last[doc])
        # Intervals of one word in one list that touch are one; in order of places, so are their ends.
        new = np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]) | (begin[1:] > end[:-1])][: len(at)]
        first = np.flatnonzero(new)
        final = np.r_[first[1:], len(at)] - 1 if len(at) else first
        place = np.r_[base, begin[first], end[final]]
        flips = np.zeros((len(place), lanes), np.int64)
        word = np.tile(term[first], 2)
        flips[np.arange(len(base), len(place)), word // 63] = np.int64(1) << (word % 63)
        owner = np.r_[np.arange(len(base)), np.tile(doc[first], 2)]
        order = np.lexsort((place, owner))
        place, owner = place[order], owner[order]
        state = np.bitwise_xor.accumulate(flips[order], axis=0)
        length = np.r_[np.where(owner[1:] == owner[:-1], place[1:], base[owner[:-1]] + last[owner[:-1]]), base[owner[-1:]] + last[owner[-1:]]] - place
        state, length = state[length > 0], length[length > 0]
        sets, which = np.unique(state, axis=0, return_inverse=True)
        counts = np.bincount(which.reshape(-1), weights=length, minlength=len(sets)).astype(np.int64)
        terms = [sorted(w for i, w in enumerate(vocabulary) if int(x[i // 63]) >> (i % 63) & 1) for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.string())), pa.array(counts)], ["terms", "n"])


def _windows(docs: DataFrame, vocabulary: list[str], size: int | None, key: str, text: str) -> DataFrame:
    """Rows (terms, n): the vocabulary words of a window of ``size`` tokens, and for how many windows of some documents they
    are the same; whole documents where ``size`` is None. The work grows with the tokens, not with tokens times words."""
    words = docs.select(tokens(F.col(text)).alias("w")).filter(F.size("w") > 0)
    if size is None:
        return words.select(F.array_sort(F.array_intersect("w", F.array(*map(F.lit, vocabulary)))).alias("terms"), F.lit(1).cast("long").alias("n"))
    expose_package(docs.sparkSession)
    return words.mapInArrow(partial(_terms_of_windows, vocabulary=sorted(set(vocabulary)), size=size), "terms array<string>, n long")


def _pairs_within(terms: str) -> Column:
    """All pairs (a < b) of a sorted array of different words."""
    return F.flatten(F.transform(terms, lambda a: F.transform(F.filter(terms, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_counts(windows: DataFrame) -> tuple[int, dict[str, int], dict[tuple[str, str], int]]:
    """(windows, windows of each term, windows of each pair of terms); all terms are top words."""
    windows = windows.groupBy("terms").agg(F.sum("n").alias("n"))
    total = windows.agg(F.sum("n")).first()[0] or 0
    singles = {r[0]: r[1] for r in windows.select(F.explode("terms").alias("t"), "n").groupBy("t").agg(F.sum("n")).collect()}
    pairs = windows.select(F.explode(_pairs_within("terms")).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))
    return total, singles, {(r.a, r.b): r.n for r in pairs.collect()}


def _npmi(a: str, b: str, total: int, singles: dict, pairs: dict, eps: float = 1e-12) -> float:
    p = lambda n: n / total
    both = p(singles.get(a, 0) if a == b else pairs.get((min(a, b), max(a, b)), 0))
    pa_, pb = p(singles.get(a, 0)), p(singles.get(b, 0))
    if not pa_ or not pb:
        return 0.0
    scale = -math.log(both + eps)
    return math.log((both + eps) / (pa_ * pb)) / scale if abs(scale) > 1e-9 else 1.0


def coherence(lists: list[list[str]], docs: DataFrame, top_n: int = 10, metric: str = "c_npmi", key: str = "pmid", text: str = "text") -> float:
    """The mean coherence of word lists: ``c_npmi`` over windows of 10 tokens, ``c_v`` over windows of 110 as the
    cosine of each word's NPMI vector with that of the whole list. NaN if no list has words."""
    lists = [[w for w in x[:top_n] if w.strip()] for x in lists]
    lists = [x for x in lists if len(x) > 1]
    if not lists:
        return float("nan")
    vocabulary = sorted({w for x in lists for w in x})
    total, singles, pairs = pair_counts(_windows(docs, vocabulary, 10 if metric == "c_npmi" else 110, key, text))
    if not total:
        return float("nan")
    scores = []
    for words in lists:
        table = np.array([[_npmi(a, b, total, singles, pairs) for b in words] for a in words])
        if metric == "c_npmi":
            scores.append(table[np.triu_indices(len(words), 1)].mean())
        else:
            whole = table.sum(axis=0)
            norms = np.linalg.norm(table, axis=1) * np.linalg.norm(whole)
            scores.append(np.mean(np.divide(table @ whole, norms, out=np.zeros(len(words)), where=norms > 0)))
    return float(np.mean(scores))


def npmi_of_documents(top: DataFrame, docs: DataFrame, topic: str = "topic_id", key: str = "pmid", text: str = "text", digits: int = 6) -> DataFrame:
    """Rows (topic, npmi): the mean NPMI of all pairs of a topic's words with whole documents as windows; documents have
    unique keys. The top words go into every document's array, and pairs are made within it."""
    words = written(top.select(topic, "term"), "top-words")  # a few words for each topic
    known = F.broadcast(words.agg(F.collect_set("term").alias("known")))  # one row
    present = docs.select(tokens(F.col(text), []).alias("w")).join(known).select(F.array_sort(F.array_intersect("w", "known")).alias("terms"))
    single = F.transform("terms", lambda a: F.struct(a.alias("a"), a.alias("b")))
    counts = present.select(F.explode(F.concat(single, _pairs_within("terms"))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = written(counts, "pair-counts")
    total = docs.agg(F.countDistinct(key).cast("double").alias("d"))
    pairs = words.select(topic, F.col("term").alias("a")).join(words.select(topic, F.col("term").alias("b")), topic).filter("a < b")
    one = counts.filter("a = b")
    singles = lambda side: one.select(F.col("a").alias(side), F.col("n").alias(f"n{side}"))
    joined = pairs.join(counts.filter("a < b").withColumnRenamed("n", "nab"), ["a", "b"], "left").join(singles("a"), "a").join(singles("b"), "b").join(F.broadcast(total))
    pab = F.coalesce("nab", F.lit(0.0)) / F.col("d") + 1e-12
    pmi = F.log(pab / (F.col("na") / F.col("d") * F.col("nb") / F.col("d")))
    npmi = F.when(F.abs(F.log(pab)) < 1e-9, 1.0).otherwise(pmi / -F.log(pab))
    return joined.select(topic, npmi.alias("v")).groupBy(topic).agg(F.round(F.avg("v"), digits).alias("npmi"))


# Clusters


def reduced(vectors: np.ndarray, n: int) -> np.ndarray:
    """Principal components of unit vectors."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    v = np.divide(vectors, length, out=np.zeros_like(vectors, np.float64), where=length > 0)
    v = v - v.mean(axis=0)
    values, axes = np.linalg.eigh(v.T @ v)
    return v @ axes[:, np.argsort(-values)[: min(n, v.shape[1])]]


def density_clusters(points: np.ndarray, least: int, samples: int) -> np.ndarray:
    """Clusters from 0, noise as -1: minimum spanning tree of mutual reachability distances, cut to a tree of clusters
    of ``least`` points at least, of which the most stable are taken."""
    n = len(points)
    if n < max(2, least):
        return np.full(n, NOISE)
    square = (points**2).sum(axis=1)
    distance = lambda i: np.sqrt(np.maximum(square[i] + square - 2 * points @ points[i], 0))
    core = np.array([np.partition(distance(i), min(samples, n - 1))[min(samples, n - 1)] for i in range(n)])
    best, parent, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        done[at] = True
        reach = np.maximum(np.maximum(distance(at), core), core[at])
        closer = ~done & (reach < best)
        best[closer], parent[closer] = reach[closer], at
        at = int(np.where(done, np.inf, best).argmin())
        edges.append((best[at], int(parent[at]), at))
    edges.sort()
    root, size, of, merges = list(range(n)), [1] * n, list(range(n)), []
    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for d, a, b in edges:  # single-linkage tree: merge k makes node n + k
        x, y = find(a), find(b)
        merges.append((of[x], of[y], d, size[x] + size[y]))
        root[y] = x
        size[x] += size[y]
        of[x] = n + len(merges) - 1
    count = lambda node: 1 if node < n else merges[node - n][3]
    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += merges[k - n][:2]
        return out
    born, children, stability, node_of = {0: 0.0}, {}, Counter(), {0: n + len(merges) - 1}
    walk = [(n + len(merges) - 1, 0)]
    while walk:
        node, cluster = walk.pop()
        if node < n:
            continue
        a, b, d, _ = merges[node - n]
        level = 1 / d if d > 0 else 1e12
        big = [x for x in (a, b) if count(x) >= least]
        if len(big) == 2:
            stability[cluster] += (level - born[cluster]) * count(node)
            for x in big:
                new = len(born)
                born[new], node_of[new] = level, x
                children.setdefault(cluster, []).append(new)
                walk.append((x, new))
        else:
            stability[cluster] += (level - born[cluster]) * (count(node) - sum(map(count, big)))
            walk += [(x, cluster) for x in big]
    taken: set[int] = set()
    value = dict(stability)
    for c in sorted(born, reverse=True):
        below = sum(value.get(x, 0) for x in children.get(c, []))
        if children.get(c) and (below > value.get(c, 0) or c == 0):
            value[c] = below
        elif c or not children:
            taken.add(c)
            stack = list(children.get(c, []))
            while stack:
                x = stack.pop()
                taken.discard(x)
                stack += children.get(x, [])
    labels = np.full(n, NOISE)
    for k, c in enumerate(sorted(taken)):
        labels[leaves(node_of[c])] = k
    return labels


#: Vectors that the driver clusters. Beyond it a sample is clustered, with the least cluster size in proportion, and all
#: others join the nearest centre within reach of it.
FIT_ROWS = 20_000


def fit(vectors: DataFrame, config: TopicConfig, key: str = "pmid", vector: str = "embedding") -> DataFrame:
    """Rows (key, topic_id, is_noise) of (key, vector)."""
    expose_package(vectors.sparkSession)
    sample = vectors.select(key, vector).orderBy(F.xxhash64(key, F.lit(config.seed)), key).limit(FIT_ROWS).toPandas()
    if sample.empty:
        return vectors.select(key, F.lit(NOISE).cast("long").alias("topic_id"), F.lit(True).alias("is_noise"))
    v = np.stack([np.asarray(x, np.float64) for x in sample[vector]])
    share = min(1.0, len(sample) / max(1, vectors.count())) if len(sample) == FIT_ROWS else 1.0
    least = max(2, round(config.min_cluster_size * share))
    labels = density_clusters(reduced(v, config.n_components), least, max(1, round((config.min_samples or config.min_cluster_size) * share)))
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    centres = np.stack([v[labels == k].mean(axis=0) for k in range(labels.max() + 1)]) if labels.max() >= 0 else np.zeros((0, v.shape[1]))
    if config.nr_topics == "auto":
        labels, centres = _merged(labels, centres, 1, NEAR_TOPICS)
    elif isinstance(config.nr_topics, int):
        labels, centres = _merged(labels, centres, config.nr_topics)
    own = dict(zip(sample[key].tolist(), labels.tolist(), strict=True))
    radius = [float((v[labels == k] @ centres[k] / max(np.linalg.norm(centres[k]), 1e-12)).min()) for k in range(len(centres))]
    sent = vectors.sparkSession.sparkContext.broadcast((own, centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12), np.array(radius)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, c, reach = sent.value
        for batch in batches:
            topics = np.full(len(batch), NOISE, np.int64)
            if len(c) and len(batch):
                x = np.stack([np.asarray(v, np.float64) for v in batch[vector]])
                sims = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ c.T
                best = sims.argmax(axis=1)
                topics = np.where(sims.max(axis=1) >= reach[best], best, NOISE)
            topics = [known.get(k, n) for k, n in zip(batch[key], topics.tolist(), strict=True)]
            yield pd.DataFrame({key: batch[key], "topic_id": topics})

    kind = dict(vectors.dtypes)[key]
    out = vectors.select(key, vector).mapInPandas(run, f"{key} {kind}, topic_id long")
    return out.withColumn("is_noise", F.col("topic_id") == NOISE)


#: Cosine of two topic centres from which automatic reduction takes them for one topic.
NEAR_TOPICS = 0.915


def _merged(labels: np.ndarray, centres: np.ndarray, most: int, least_similarity: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The smallest topic joins the nearest until ``most`` are left; with ``least_similarity`` the two nearest topics
    become one while they are that similar."""
    labels = labels.copy()
    while len(centres) > max(1, most):
        sizes = np.bincount(labels[labels >= 0], minlength=len(centres))
        small = int(sizes.argmin())
        unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        if least_similarity is not None:
            every = unit @ unit.T
            np.fill_diagonal(every, -np.inf)
            if every.max() < least_similarity:
                break
            pair = np.unravel_index(int(every.argmax()), every.shape)
            small = int(min(pair, key=lambda k: (sizes[k], -k)))
        sims = unit @ unit[small]
        sims[small] = -np.inf
        to = int(sims.argmax())
        centres[to] = (centres[to] * sizes[to] + centres[small] * sizes[small]) / (sizes[to] + sizes[small])
        labels[labels == small] = to
        labels[labels > small] -= 1
        centres = np.delete(centres, small, axis=0)
    return labels, centres


# Hierarchy


def merges_of(centres: dict[int, np.ndarray]) -> list[tuple[float, list[int], list[int]]]:
    """Average-linkage merges (distance, leaves, leaves) of topic centres by cosine distance."""
    groups = {k: [k] for k in sorted(centres)}
    unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in centres.items()}
    out = []
    while len(groups) > 1:
        keys = sorted(groups)
        d, a, b = min((1 - np.mean([unit[x] @ unit[y] for x in groups[a] for y in groups[b]]), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        out.append((float(d), list(groups[a]), list(groups[b])))
        groups[a] = groups[a] + groups.pop(b)
    return out


def cut(leaves: list[int], merges: list[tuple[float, list[int], list[int]]], target: int, leaf_only: bool = False) -> dict[int, int]:
    """Groups of leaves after merges in ascending order until ``target`` are left, as dense ranks of their least
    leaf. ``leaf_only`` replays only merges of two single leaves, as the published hierarchy does."""
    root = {x: x for x in leaves}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    left = len(leaves)
    for _, a, b in sorted(merges, key=lambda m: m[0]):
        if left <= max(1, target):
            break
        if leaf_only and (len(a) > 1 or len(b) > 1):
            continue
        x, y = find(a[0]), find(b[0])
        if x != y:
            root[max(x, y)] = min(x, y)
            left -= 1
    rank = {r: i for i, r in enumerate(sorted({find(x) for x in leaves}))}
    return {x: rank[find(x)] for x in leaves}


def centres_of(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows (topic_id, centre): the mean vector of each topic."""
    parts = rows.select("topic_id", F.posexplode(vector).alias("d", "x")).groupBy("topic_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s.m).alias("centre"))


def representatives(assigned: DataFrame, vectors: DataFrame, n: int = 3, key: str = "pmid", vector: str = "embedding") -> DataFrame:
    """Rows (topic_id, representative_docs, size): the ``n`` documents nearest to the centre of each topic but noise."""
    rows = assigned.filter(F.col("topic_id") != NOISE).join(vectors.select(key, vector), key)
    near = rows.join(centres_of(rows, vector), "topic_id").withColumn("s", F.round(cosine(F.col(vector), F.col("centre")), 9))
    best = top_per_group(near, ["topic_id"], [F.desc("s"), F.asc(key)], n)
    docs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), F.col(key).alias("k")))), lambda x: x.k.cast("long"))
    sizes = rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    return best.groupBy("topic_id").agg(docs.alias("representative_docs")).join(sizes, "topic_id").select("topic_id", "representative_docs", "size")


def hierarchy(assigned: DataFrame, vectors: DataFrame, words: DataFrame, config: TopicConfig = TopicConfig(), leaf_only: bool = False, key: str = "pmid", vector: str = "embedding") -> DataFrame:
    """Rows of topic_hierarchy: a leaf's words, size, groups, and the three documents nearest to its centre."""
    spark = assigned.sparkSession
    rows = assigned.filter(F.col("topic_id") != NOISE).join(vectors.select(key, vector), key)
    centres = {r.topic_id: np.array(r.centre) for r in centres_of(rows, vector).collect()}  # a vector for each topic
    merges, leaves = merges_of(centres), sorted(centres)
    mid, top = cut(leaves, merges, config.mid_target, leaf_only), cut(leaves, merges, config.top_target, leaf_only)
    best = representatives(assigned, vectors, 3, key, vector)
    groups = spark.createDataFrame([(k, mid[k], top[k]) for k in leaves], "topic_id long, mid_level_id long, top_level_id long")
    lists = words.select("topic_id", F.slice("words", 1, 10).alias("top_words"))
    joined = groups.join(lists, "topic_id", "left").join(best, "topic_id")
    return joined.select("topic_id", F.coalesce("top_words", F.array().cast("array<string>")).alias("top_words"), "size", "mid_level_id", "top_level_id", F.coalesce("representative_docs", F.array().cast("array<long>")).alias("representative_docs"))


# Saved models


def save_model(path: str, assigned: DataFrame, vectors: DataFrame, words: DataFrame, config: TopicConfig, key: str = "pmid", vector: str = "embedding") -> None:
    """A model as tables below ``path``: its configuration, the centre, reach and words of every topic. The reach is the
    cosine of the farthest member."""
    rows = assigned.filter(F.col("topic_id") != NOISE).join(vectors.select(key, vector), key)
    centres = centres_of(rows, vector)
    reach = rows.join(centres, "topic_id").groupBy("topic_id").agg(F.min(cosine(F.col(vector), F.col("centre"))).alias("reach"), F.count(F.lit(1)).alias("size"))
    model = centres.join(reach, "topic_id").join(words.select("topic_id", "words"), "topic_id", "left")
    model.write.mode("overwrite").parquet(f"{path}/topics")
    assigned.sparkSession.createDataFrame([(json.dumps(asdict(config), sort_keys=True),)], "config string").write.mode("overwrite").parquet(f"{path}/config")


def load_model(spark, path: str) -> tuple[TopicConfig, DataFrame]:
    """(configuration, topics: topic_id, centre, reach, size, words) of a saved model."""
    config = TopicConfig(**json.loads(spark.read.parquet(f"{path}/config").first().config))
    return config, spark.read.parquet(f"{path}/topics")


def apply_model(vectors: DataFrame, model: DataFrame, key: str = "pmid", vector: str = "embedding") -> DataFrame:
    """Rows (key, topic_id, is_noise): the nearest centre within whose reach a vector is, else noise."""
    topics = F.broadcast(model.select("topic_id", "centre", "reach"))  # a row for each topic
    near = vectors.select(key, vector).join(topics).withColumn("s", cosine(F.col(vector), F.col("centre")))
    best = near.groupBy(key).agg(F.max(F.struct("s", (-F.col("topic_id")).alias("t"), "reach")).alias("best"))
    inside = F.coalesce(F.col("best.s") >= F.col("best.reach") - 1e-9, F.lit(False))
    out = best.select(key, F.when(inside, -F.col("best.t")).otherwise(NOISE).cast("long").alias("topic_id"))
    return out.withColumn("is_noise", F.col("topic_id") == NOISE)


# Sweep


def sweep(vectors: DataFrame, docs: DataFrame, configs: list[TopicConfig], key: str = "pmid") -> DataFrame:
    """Rows of topic_sweep; a configuration that fails has its error in its row."""
    out = []
    for config in configs:
        began = time.time()
        try:
            assigned = fit(vectors, config, key).cache()
            row = assigned.agg(F.countDistinct(F.when(~F.col("is_noise"), F.col("topic_id"))).alias("n"), F.avg(F.col("is_noise").cast("double")).alias("noise")).first()
            lists = [r.words for r in word_lists(top_words(class_weights(docs.join(assigned.filter("NOT is_noise").select(key, "topic_id"), key), ngram=config.ngram, min_df=config.min_df), n=config.top_n)).collect()]
            scores = [coherence(lists, docs, config.top_n, m, key) for m in ("c_npmi", "c_v")]
            out.append((json.dumps(asdict(config), sort_keys=True), row.n, row.noise, *[None if math.isnan(s) else s for s in scores], time.time() - began, None))
            assigned.unpersist()
        except Exception as e:
            out.append((json.dumps(asdict(config), sort_keys=True), None, None, None, None, time.time() - began, f"{type(e).__name__}: {e}"[:500]))
    return vectors.sparkSession.createDataFrame(out, "config string, n_leaf_topics long, noise_fraction double, npmi_top10 double, cv_top10 double, wall_seconds double, error string")


def choose(swept: DataFrame, selector: str = "npmi_top10", leaves: tuple[int, int] = (100, 200), noise: float = 0.2) -> DataFrame:
    """One row of the sweep with ``constraints_unmet``: the best that meets the constraints, else the best at all;
    none if every configuration failed."""
    score = F.when(~F.isnan(selector), F.col(selector))
    met = F.col("n_leaf_topics").between(*leaves) & (F.col("noise_fraction") <= noise)
    return swept.filter("error IS NULL").withColumn("constraints_unmet", ~F.coalesce(met, F.lit(False))).orderBy("constraints_unmet", score.desc_nulls_last(), "config").limit(1)


def near_misses(swept: DataFrame, selector: str = "npmi_top10", n: int = 3) -> DataFrame:
    return swept.filter("error IS NULL").orderBy(F.col(selector).desc_nulls_last(), "config").limit(n)


def grid(base: TopicConfig, **values) -> list[TopicConfig]:
    """All combinations of parameter values over a base."""
    out = [base]
    for name, options in values.items():
        out = [replace(c, **{name: v}) for c in out for v in options]
    return out
