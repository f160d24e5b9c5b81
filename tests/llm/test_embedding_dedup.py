import numpy as np
import pytest

from litmill.llm import embedding_dedup as E


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    for k in range(40):
        centre = rng.normal(size=16)
        spread = [0.02, 0.05, 0.3][k % 3]
        rows += [(len(rows) + j, (centre + spread * rng.normal(size=16)).tolist(), k % 2) for j in range(int(rng.integers(1, 40)))]
    n = len(rows)
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(30)] + [(n + 40, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(-1, None, 1), (-2, [0.0] * 16, 1), (-3, [float("nan")] + [1.0] * 15, 1), (-4, None, None), (-5, [1.0] * 16, None), (-6, [None] + [1.0] * 15, 0), (-7, [1.0] * 3, 0), (-8, [1.0] * 3, 0), (-9, [], 0), (-10, [float("inf")] * 16, 0)]
    return [(i, v, k, "x") for i, v, k in rows]


@pytest.mark.parametrize(("shard", "block"), [(1000, 2048), (60, 150), (20, 40)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(E, "SHARD", shard)
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    seen = []
    monkeypatch.setattr(E, "audit", lambda *a, audit=E.audit: seen.append(audit(*a)) or seen[-1])
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    links = {i: set() for i, *_ in rows}
    for k in (0, 1):
        for dim in (3, 16):
            part = [(i, v) for i, v, x, _ in rows if x == k and v and len(v) == dim and all(y is not None and np.isfinite(y) for y in v) and any(v)]
            if part:
                m = np.array([v for _, v in part])
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                for a, b in zip(*np.nonzero(m @ m.T >= 0.98), strict=True):
                    if a != b:
                        links[part[a][0]].add(part[b][0])
    found, want = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links) and found >= (0.97 if shard == 1000 else 0.9) * want
    for i in (-1, -2, -3, -4, -5, -6, -9, -10):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[-7].component_id == -8 and not got[-7].kept
    root = {}
    for i in sorted(links):
        if i not in root:
            stack, root[i] = [i], i
            while stack:
                for x in links[stack.pop()]:
                    if x not in root:
                        root[x] = i
                        stack.append(x)
    assert sum(got[i].component_id == root[i] for i in links) >= 0.97 * len(links)
    assert seen[-1] >= E.LEAST_RECALL and E.near_duplicates(df.limit(0)).count() == 0


def brute_links(rows):
    links = {i: set() for i, *_ in rows}
    v = np.array([x for _, x, _ in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for a, b in zip(*np.nonzero(v @ v.T >= 0.98), strict=True):
        if a != b and rows[a][2] == rows[b][2]:
            links[rows[a][0]].add(rows[b][0])
    return links


def test_neighbours_in_other_shards_are_found(spark, monkeypatch):
    """Small shards cut through the groups; the united lists lead across."""
    monkeypatch.setattr(E, "SHARD", 24)
    monkeypatch.setattr(E, "BLOCK", 10_000)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        centre = rng.normal(size=12)
        rows += [(len(rows) + j, (centre + 0.06 * rng.normal(size=12)).tolist(), 0) for j in range(5)]
    links = brute_links(rows)
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(map(len, links.values())) > 1000
    assert all(got[i] <= len(x) for i, x in links.items()) and sum(got.values()) >= 0.95 * sum(map(len, links.values()))


def test_failing_search_is_noticed(spark, monkeypatch):
    rows = [r[:3] for r in vectors() if r[0] >= 0]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(E, "range_search", lambda v, lists, q, threshold, beam: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    links = brute_links(rows)
    assert {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()} == {i: len(x) for i, x in links.items()}
    nodes = E.nodes_of(df.select(df.vec_id.alias("id"), "embedding", "label"))
    assert E.audit(nodes, spark.createDataFrame([], "node long, linked long"), 0.98) == 0.0
    assert E.audit(nodes, spark.createDataFrame([], "node long, linked long"), 1.5) is None
