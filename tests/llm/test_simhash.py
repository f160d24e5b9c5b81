import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from litmill.llm import simhash as S
from litmill.llm.common import Scratch, components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_keys_lose_nothing():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 5000)
    near = words ^ np.array([(1 << a) | (1 << b) for a, b in rng.integers(0, 23, (5000, 2))])
    a, b = S.segment_keys(words, 23), S.segment_keys(near, 23)
    assert set((a >= 0).sum(axis=1)) == {1, 6}
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))
    fp = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = fp.copy()
    for _ in range(4):
        other ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    keys = [set(zip(*(x.tolist() for x in S.golay_keys(v)), strict=True)) for v in (fp, other)]
    assert {o for o, _ in keys[0] & keys[1]} == set(range(2000))


def _texts():
    rng = random.Random(3)
    words = ["knee", "joint", "bone", "éclair", "ligament", "graft", "screw", "pain", "scale", "trial"]
    base = [[rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 120))] for _ in range(60)]
    out = []
    for b in base:
        for _ in range(rng.randint(1, 6)):
            c = list(b)
            if rng.random() < 0.7:
                c[rng.randrange(len(c))] = "changed"
            out.append(rng.choice([" ", "\n", "\t "]).join(c))
    return [None, "", " \x0b", "A b", "a\tB", "x " * 5000] + out


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    rows = [(i, t, "extra") for i, t in enumerate(_texts())]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, fp string")
    want_fp = {i: fingerprint(t) for i, t, _ in rows}
    ids = sorted(want_fp)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (want_fp[a] ^ want_fp[b]).bit_count() <= 4])
    for limit in (S.GROUP, 2):  # the second way for large groups too
        monkeypatch.setattr(S, "GROUP", limit)
        got = S.near_duplicates(df).collect()
        assert len(got) == len(rows) + 3
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{want_fp[i]:016x}", want[i]) for i in ids}
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long, "de", 1), (2, long + " x", "de", 2), (None, long, "fr", 3), (3, "other text here now", None, 4), (3, "yet another text here", None, 5), (None, None, None, 6), (None, "alone " * 3, None, 7), (4, "twice", None, 8), (4, "twice", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string, _own int")
    kept = S.keep_one(df, lambda d, i, t: S.near_duplicates(d, 4, i, t)).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "row_key", "_own"]
    assert sum(r._own in (1, 2, 3) for r in kept) == 1 and sorted(r._own for r in kept if r._own > 3) == [4, 5, 6, 7, 8]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(Scratch(spark, "t"), df).collect()}
    want = groups(sorted({x for e in edges for x in e}), edges)
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if any(k in e and e[0] != e[1] for e in edges)} == set(got)
    assert components(Scratch(spark, "t"), df.filter(F.lit(False))).count() == 0
