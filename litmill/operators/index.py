"""An index for approximate nearest neighbours: navigable graphs over shards of vectors, as a table.

Vectors are dealt to shards of at most ``SHARD`` by a hash of their row ids. A shard's graph links every vector to near ones,
none of which is nearer to one taken before than to the vector itself, and to a few anywhere, in both directions. A search
walks every shard's graph from several entries with a list of ``ef`` candidates, and the best of all shards are the result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.session import expose_package
from litmill.sources.tables import replace_table, with_row_ids

SHARD = 8192
ENTRIES = 8
SCHEMA = "shard long, row_id long, id {kind}, embedding array<double>, neighbours array<int>"


def _unit(rows: list) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in rows])
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def graph(v: np.ndarray, m: int, ef_construction: int) -> list[np.ndarray]:
    """Neighbours of every unit vector: up to ``m`` chosen of the nearest ``ef_construction``, some at random, and what
    links back, up to three times ``m`` in all."""
    n = len(v)
    k = min(ef_construction, n - 1)
    far = np.random.default_rng(n).integers(0, n, (n, max(1, m // 2)))
    chosen: list[list[int]] = []
    for i in range(0, n, 512):
        sims = v[i : i + 512] @ v.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        near = np.argpartition(sims, -k, axis=1)[:, -k:] if k else np.zeros((len(sims), 0), np.int64)
        for row, candidates in enumerate(near):
            order = candidates[np.argsort(-sims[row, candidates], kind="stable")]
            own: list[int] = []
            for c in order.tolist():
                if len(own) == m:
                    break
                if not own or sims[row, c] >= (v[own] @ v[c]).max():
                    own.append(c)
            chosen.append(own + [x for x in far[i + row].tolist() if x != i + row])
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(chosen):
        for c in own:
            back[c].append(i)
    return [np.array(list(dict.fromkeys(own + b))[: 3 * m], np.int32) for own, b in zip(chosen, back, strict=True)]


def walk(v: np.ndarray, neighbours: list[np.ndarray], q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the ``k`` best of ``v`` for a unit query, -1 where fewer were met."""
    entries = np.unique(np.linspace(0, len(v) - 1, ENTRIES).astype(np.int64))
    seen = np.zeros(len(v), bool)
    seen[entries] = True
    ids, sims, done = entries, v[entries] @ q, np.zeros(len(entries), bool)
    while not done.all():
        at = int(np.where(done, -3, sims).argmax())
        done[at] = True
        new = neighbours[ids[at]]
        new = new[~seen[new]]
        seen[new] = True
        ids, sims, done = np.concatenate((ids, new)), np.concatenate((sims, v[new] @ q)), np.concatenate((done, np.zeros(len(new), bool)))
        if len(ids) > ef:
            best = np.argpartition(-sims, ef - 1)[:ef]
            ids, sims, done = ids[best], sims[best], done[best]
    best = np.argsort(-sims, kind="stable")[:k]
    return ids[best], sims[best]


def build(vectors: DataFrame, m: int = 32, ef_construction: int = 200, key: str = "pmid", vector: str = "embedding") -> DataFrame:
    """The index as a table (``SCHEMA``). ValueError for parameters below 1, an empty table or vectors of unequal length."""
    if m < 1 or ef_construction < 1:
        raise ValueError("m and ef_construction must be 1 at least")
    sizes = [r[0] for r in vectors.select(F.size(vector)).distinct().limit(2).collect()]
    if not sizes:
        raise ValueError("there are no vectors to index")
    if len(sizes) > 1 or sizes[0] < 1:
        raise ValueError("vectors must be of one length")
    expose_package(vectors.sparkSession)
    kind = dict(vectors.dtypes)[key]
    shards = max(1, -(-vectors.count() // SHARD))
    numbered = with_row_ids(vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("embedding")), [F.col("id").asc()])
    rows = numbered.select(F.pmod(F.xxhash64("row_id"), F.lit(shards)).alias("shard"), F.col("row_id").cast("long").alias("row_id"), "id", "embedding")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        lists = graph(_unit(list(pdf["embedding"])), m, ef_construction)
        return pdf.assign(neighbours=[x.tolist() for x in lists])

    return rows.groupBy("shard").applyInPandas(link, SCHEMA.format(kind=kind))


def save(index: DataFrame, path: str) -> None:
    """Writes an index, or puts it in the place of another at once."""
    replace_table(index, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The index; ValueError if the table is none."""
    index = spark.read.parquet(path)
    if not {"shard", "row_id", "id", "embedding", "neighbours"} <= set(index.columns):
        raise ValueError(f"{path} is not an index")
    return index


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = 64, key: str = "pmid", vector: str = "embedding") -> DataFrame:
    """Rows (query, neighbour, similarity, rank): about the ``k`` nearest of the index, the query's own id left out.
    Queries go to every shard, in blocks."""
    expose_package(index.sparkSession)
    kind, asks = dict(index.dtypes)["id"], queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
    shards = F.broadcast(index.select("shard").distinct())
    q = asks.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // SHARD))))).join(shards)
    blocks = F.broadcast(q.select("block").distinct())
    rows = q.select("shard", "block", F.lit(None).cast("long").alias("row_id"), "id", "embedding", F.lit(None).cast("array<int>").alias("neighbours"))
    rows = rows.unionByName(index.join(blocks).select("shard", "block", "row_id", "id", "embedding", "neighbours"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        held, asked = pdf[pdf["row_id"].notna()].sort_values("row_id"), pdf[pdf["row_id"].isna()]
        if held.empty or asked.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "similarity": []})
        v, ids, lists = _unit(list(held["embedding"])), held["id"].to_numpy(), [np.asarray(x, np.int64) for x in held["neighbours"]]
        parts = []
        for name, x in zip(asked["id"], _unit(list(asked["embedding"])), strict=True):
            at, sims = walk(v, lists, x, k + 1, max(ef, k + 1))
            other = ids[at] != name
            parts.append(pd.DataFrame({"query": name, "neighbour": ids[at][other], "similarity": sims[other]}))
        return pd.concat(parts)

    found = rows.groupBy("shard", "block").applyInPandas(find, f"query {kind}, neighbour {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def lookup(index: DataFrame, ids: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows (key, embedding) of ids that the index holds."""
    return index.select(F.col("id").alias(key), "embedding").join(ids.select(key).distinct(), key, "left_semi")

