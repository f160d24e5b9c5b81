"""Extensions beyond the implemented operators: citation disruption, semantic novelty, forecasts, lead and lag."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.session import expose_package, written
from litmill.sources.tables import with_row_ids


#: Citations of a part of the cited works and of a block of the focal ones, and pairs of works compared at once.
PART_EDGES, BLOCK_EDGES, PAIRS_AT_ONCE = 1_000_000, 250_000, 4_000_000
_BLOBS = ("lists", "sizes", "at", "n", "works", "counts", "citers")


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of the bytes of their differences; small where they ascend in short steps."""
    lo, width, x = 0, 8, x.astype(np.int64)
    steps = len(x) > 0 and int(x.max()) - int(x.min()) < 2**61 and abs(int(x[0])) < 2**61  # differences that don't run over
    if steps:
        x = np.diff(x, prepend=0)
        lo = int(x.min())
        x = x - lo
        width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return struct.pack("<qqq?", len(x), lo, width, steps) + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n, lo, width, steps = struct.unpack_from("<qqq?", blob)
    planes = np.frombuffer(pa.decompress(blob[25:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :width] = planes.T
    x = whole.reshape(-1).view("<i8")
    return np.cumsum(x + lo) if steps else x


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of slices, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _citers_by_block(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each block of focal works, the lists of citing works that it needs: those of what its works cite, with the place
    of its own works in them (a slice, as lists and blocks are in the order of ids), and those of its works themselves."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    c, r = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    order = np.lexsort((c, r))
    c, r = c[order], r[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])]
    c, r = c[new], r[new]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    size, works = np.diff(np.r_[start, len(r)]), r[start]
    home, block, of = np.searchsorted(bounds, works, "right"), np.searchsorted(bounds, c, "right"), np.repeat(np.arange(len(start)), size)
    run = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1])])
    length, at = np.diff(np.r_[run, len(r)]), run - start[of[run]]
    to = block[run]
    shared = size[of[run]] > 1  # a list of one work says nothing of others
    run, length, at, to = run[shared], length[shared], at[shared], to[shared]
    by_to, by_home = np.argsort(to, kind="stable"), np.argsort(home, kind="stable")
    for p in np.union1d(to, home).tolist():
        i = by_to[slice(*np.searchsorted(to, [p, p + 1], sorter=by_to))]
        j = by_home[slice(*np.searchsorted(home, [p, p + 1], sorter=by_home))]
        mine = of[run[i]]
        parts = (c[_ranges(start[mine], size[mine])], size[mine], at[i], length[i], works[j], size[j], c[_ranges(start[j], size[j])])
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *(pa.array([_packed(x)], pa.binary()) for x in parts)], ["p", *_BLOBS])


def _later_of_block(table: pa.Table) -> pa.Table:
    """Rows (focal, n, total) of a block: how many works cite the focal work or what it cites, and the sum of -2 f b + f."""
    lists, sizes, at, n, works, counts, citers = (np.concatenate([_unpacked(b) for b in table.column(x).to_pylist()]) for x in _BLOBS)
    order = np.argsort(works)
    starts = (np.cumsum(counts) - counts)[order]
    works, counts = works[order], counts[order]
    first = np.cumsum(sizes) - sizes
    focal, entry = lists[_ranges(first + at, n)], np.repeat(np.arange(len(sizes)), n)
    order = np.argsort(focal, kind="stable")
    focal, entry = focal[order], entry[order]
    begin = np.flatnonzero(np.r_[True, focal[1:] != focal[:-1]]) if len(focal) else np.zeros(0, np.int64)
    names, reach, weight = focal[begin], np.r_[begin, len(focal)], np.r_[0, np.cumsum(sizes[entry])]
    values = None
    lo, hi = (int(lists.min()), int(lists.max())) if len(lists) else (0, 0)
    if (hi - lo + 1) * max(1, len(names)) >= 2**62:
        values, lists = np.unique(lists, return_inverse=True)
        lo, hi = 0, len(values) - 1
    else:
        lists = lists - lo
    span = hi - lo + 1

    def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of works, and whether they are in any list."""
        if values is None:
            return np.clip(x, lo, hi) - lo, (x >= lo) & (x <= hi)
        k = np.minimum(np.searchsorted(values, x), len(values) - 1)
        return k, values[k] == x

    def pairs(a: int, b: int) -> np.ndarray:
        """Different pairs (focal, later) as sorted numbers, of entries a to b."""
        whole = None
        while a < b:
            to = min(b, max(a + 1, int(np.searchsorted(weight, weight[a] + PAIRS_AT_ONCE, "right")) - 1))
            e = entry[a:to]
            keys = np.repeat(np.searchsorted(names, focal[a:to]) * span, sizes[e]) + lists[_ranges(first[e], sizes[e])]
            keys.sort()
            keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
            whole = keys if whole is None else np.union1d(whole, keys)
            a = to
        return whole

    through, both = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    load, k = weight[reach], 0
    while k < len(names):
        to = max(k + 1, int(np.searchsorted(load, load[k] + PAIRS_AT_ONCE, "right")) - 1)
        keys = pairs(reach[k], reach[to])
        through[k:to] = np.diff(np.searchsorted(keys, np.arange(k, to + 1) * span)) - 1  # without the focal work itself
        place = np.minimum(np.searchsorted(works, names[k:to]), max(0, len(works) - 1))
        cited = np.flatnonzero(works[place] == names[k:to]) if len(works) else np.zeros(0, np.int64)
        own = np.repeat(cited + k, counts[place[cited]])
        later = citers[_ranges(starts[place[cited]], counts[place[cited]])]
        codes, known = code(later)
        want = own * span + codes
        found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = known & (keys[found] == want) & (later != names[own])
        both[k:to] = np.bincount(own[hit] - k, minlength=to - k)
        k = to
    focals = np.union1d(names, works)
    direct, b, fb = (np.zeros(len(focals), np.int64) for _ in range(3))
    direct[np.searchsorted(focals, works)] = counts
    b[np.searchsorted(focals, names)], fb[np.searchsorted(focals, names)] = through, both
    return pa.table({"focal": focals, "n": direct + b - fb, "total": direct - 2 * fb})


def cd_index(edges: DataFrame, citing: str = "citing", cited: str = "cited") -> DataFrame:
    """Rows (focal, n, cd): over works that cite the focal work or what it cites, the mean of -2 f b + f, where f is
    1 if the focal work is cited and b if one of its references is.

    Pairs of works are made in the memory of blocks of focal works, by bounded portions. What is shuffled are the citations and
    packed lists of citing works, one for each block with a work in it; blocks are ranges of ids, so neighbours share lists."""
    spark = edges.sparkSession
    expose_package(spark)
    e = edges.select(F.col(citing).alias("c"), F.col(cited).alias("r"))
    kind = e.select("r").union(e.select("c")).dtypes[0][1]
    known, coded = e.filter("c IS NOT NULL AND r IS NOT NULL"), None
    if not {t for _, t in e.dtypes} <= {"tinyint", "smallint", "int", "bigint"}:
        ids = known.select(F.col("c").alias("id")).union(known.select("r")).distinct()
        coded = written(with_row_ids(ids, [F.col("id").asc()], "code"), "works")
        named = lambda side: coded.select(F.col("id").alias(side), F.col("code").alias(f"k{side}"))
        known = known.join(named("c"), "c").join(named("r"), "r").select(F.col("kc").alias("c"), F.col("kr").alias("r"))
    known = known.select(F.col("c").cast("long").alias("c"), F.col("r").cast("long").alias("r"))
    rows, odd = e.agg(F.count(F.lit(1)), F.count_if(F.col("c").isNull() | F.col("r").isNull())).first()
    blocks = max(1, -(-rows // BLOCK_EDGES))
    shares = [i / blocks for i in range(1, blocks)]
    bounds = np.unique(np.array(known.approxQuantile("c", shares, 0.2 / blocks) if shares else [], np.float64).astype(np.int64))
    lists = known.repartitionByRange(max(1, -(-rows // PART_EDGES)), "r").mapInArrow(partial(_citers_by_block, bounds=bounds), "p long, " + ", ".join(f"{x} binary" for x in _BLOBS))
    found = lists.groupBy("p").applyInArrow(_later_of_block, "focal long, n long, total long")
    found = found.join(coded, F.col("focal") == F.col("code")).select(F.col("id").alias("focal"), "n", "total") if coded else found.withColumn("focal", F.col("focal").cast(kind))
    if odd:  # an unknown work cites, or is cited, without being anyone's neighbour
        few = e.filter("c IS NULL OR r IS NULL").distinct().groupBy(F.col("r").alias("focal")).agg(F.count(F.lit(1)).alias("n"))
        found = found.union(few.select("focal", "n", F.col("n").alias("total"))).groupBy("focal").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return found.select("focal", "n", (F.col("total").cast("double") / F.col("n")).alias("cd"))


def semantic_novelty(vectors: DataFrame, key: str, field: str, year: str, vector: str = "embedding") -> DataFrame:
    """Rows (key, n_earlier, mean_distance, min_distance) against all earlier vectors of the field. The mean needs only
    the sum of earlier unit vectors; the minimum compares blocks."""
    expose_package(vectors.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(x, np.float64) for x in pdf["v"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        mine, mate = pdf["side"].to_numpy() == 0, pdf["side"].to_numpy() == 1
        q, d = np.flatnonzero(mine), np.flatnonzero(mate)
        if not len(q) or not len(d):
            return pd.DataFrame({"k": [], "n": [], "total": [], "least": []})
        years = pdf["y"].to_numpy()
        out = []
        for i in range(0, len(q), 512):
            part = q[i : i + 512]
            dist = 1 - v[part] @ v[d].T
            earlier = years[d][None, :] < years[part][:, None]
            n = earlier.sum(axis=1)
            out.append(pd.DataFrame({"k": pdf["k"].to_numpy()[part], "n": n, "total": np.where(earlier, dist, 0).sum(axis=1), "least": np.where(earlier, dist, np.inf).min(axis=1)})[n > 0])
        return pd.concat(out)

    rows = vectors.select(F.col(key).alias("k"), F.col(field).alias("f"), F.col(year).alias("y"), F.col(vector).alias("v"))
    sizes = rows.groupBy("f").agg(F.ceil(F.count(F.lit(1)) / 2048).cast("long").alias("blocks"))
    dealt = rows.join(sizes, "f").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asks = dealt.select("f", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "k", "y", "v")
    gives = dealt.select("f", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "k", "y", "v")
    kind = dict(vectors.dtypes)[key]
    found = asks.union(gives).groupBy("f", "i", "j").applyInPandas(run, f"k {kind}, n long, total double, least double")
    return found.groupBy(F.col("k").alias(key)).agg(F.sum("n").alias("n_earlier"), (F.sum("total") / F.sum("n")).alias("mean_distance"), F.min("least").alias("min_distance"))


def archetypes(df: DataFrame, novelty: str, disruption: str) -> DataFrame:
    """Adds the quadrant by the medians of novelty and disruption."""
    m = df.agg(F.percentile(novelty, 0.5).alias("mn"), F.percentile(disruption, 0.5).alias("md"))
    high_n, high_d = F.col(novelty) > F.col("mn"), F.col(disruption) > F.col("md")
    name = F.when(high_n & high_d, "frontier").when(high_n, "isolated").when(high_d, "repackaging").otherwise("consolidation")
    return df.join(F.broadcast(m)).withColumn("archetype", name).drop("mn", "md")


def moving_average(shares: DataFrame, group: str, period: str, value: str, periods: int = 3) -> DataFrame:
    """Adds ``forecast``: the mean of the periods before."""
    before = Window.partitionBy(group).orderBy(period).rowsBetween(-periods, -1)
    return shares.withColumn("forecast", F.avg(value).over(before))


def temporal_split(year: Column) -> Column:
    return F.when(year <= 2017, "train").when(year <= 2020, "validation").otherwise("test")


def lead_lag(series: DataFrame, group: str, period: str, a: str, b: str, most: int = 3) -> DataFrame:
    """Rows (group, lag, correlation) of ``a`` with ``b`` that many periods later."""
    w = Window.partitionBy(group).orderBy(period)
    parts = [series.select(group, F.lit(k).alias("lag"), F.col(a).alias("x"), F.lead(b, k).over(w).alias("y")) for k in range(most + 1)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.filter("y IS NOT NULL").groupBy(group, "lag").agg(F.corr("x", "y").alias("correlation"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rho): the correlation of mean ranks."""
    def ranked(df: DataFrame, c: str) -> DataFrame:
        n = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(c)) - F.col("_n")
        return n.withColumn(f"_r{c}", before + (F.col("_n") + 1) / 2).drop("_n")

    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return known.join(ranked(known, a), a).join(ranked(known, b), b).agg(F.corr(f"_r{a}", f"_r{b}").alias("rho"))

