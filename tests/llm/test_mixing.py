import random

import pytest

from litmill.llm import mixing as M


def docs(spark, n=1500):
    rng = random.Random(2)
    source = lambda i: ["a", "b", "c", None, "é", "tiny"][min(5, int(rng.random() ** 2 * 6))] if i % 50 else "tiny"
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 400])), source(i), "x") for i in range(n)]
    rows += [(9001, None, "a", "x"), (9002, " \n", "b", "x"), (9003, "same text", "c", "x"), (9003, "same text", "c", "x"), (None, "a b c", "a", "x"), (9004, "w " * 3000, "b", "x"), (9005, "", "empty", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, own_hash string")


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, target = float(sum(sizes.values())), {s: 0.0 for s in sizes}
    full = {s for s in sizes if not sizes[s]}
    while True:
        left = total - sum(3.0 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        w = sum(weight[s] for s in open_)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in sizes}
        over = {s for s in open_ if target[s] > 3.0 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("bucket", [4096, 64])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    df = docs(spark)
    got = M.mix(df).collect()
    assert len(got) == df.count() and got[0].__fields__ == ["doc_id", "size", "source_size", "target", "taken"]
    source = {r.doc_id: r.source for r in df.collect()}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    assert {s: r.source_size for r in got for s in [source[r.doc_id]]} == sizes
    want = expected_targets(sizes)
    assert all(target[s] == pytest.approx(want[s]) for s in sizes) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 60) for s in sizes), {s: (taken[s], target[s]) for s in sizes}
    again = M.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mixed_takes_the_same(spark):
    df = docs(spark, 300)
    want = {}
    for r in M.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    rows = M.mixed(df)
    assert rows.columns == df.columns
    got = {}
    for r in rows.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").split())
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
    assert M.mix(df.limit(0)).count() == 0 and M.mixed(df.limit(0)).count() == 0


def test_balance():
    rng = random.Random(4)
    for n in (1, 2, 3, 10, 500):
        size, p = [float(rng.choice([1, 5, 50])) for _ in range(n)], [0.37] * n
        want, count = sum(s * 0.37 for s in size), 0.37 * n
        M.settle(size, p, [rng.random() for _ in range(2 * n + 3)], True)
        assert set(p) <= {0.0, 1.0}
        assert abs(sum(s * q for s, q in zip(size, p, strict=True)) - want) <= 51 and abs(sum(p) - count) <= 3
