import random

import pytest

import corpus_pipeline
from litmill.llm import shingle_dedup as S
from litmill.llm.common import Scratch, components


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def documents():
    rng = random.Random(3)
    texts = [None, "", "two words", "Two  WORDS", "other words"]
    boiler = " ".join(f"b{i}" for i in range(30))
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 300))]
        texts += [" ".join(words), boiler + " " + " ".join(words)]
        for changed in (1, 2, 4, 8):
            other = list(words)
            for at in rng.sample(range(len(other)), min(changed, len(other) // 10 + 1)):
                other[at] += "x"
            texts.append(" ".join(other))
        texts.append(" ".join(words[: int(len(words) * rng.uniform(0.75, 1))]))
    rng.shuffle(texts)
    return texts


def sets_of(texts):
    return [shingles(t) for t in texts]


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [1024, 3])
def test_stage_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    texts = documents()
    sets = sets_of(texts)
    pairs = {(j, i): similarity(sets[i], sets[j]) for i in range(len(texts)) for j in range(i)}
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.doc_id: r.component_id for r in S.near_copies(df).collect()}
    truth = groups(len(texts), [p for p, s in pairs.items() if s >= 0.8])
    assert all(truth[i] == truth[got[i]] for i in got)  # no group holds what isn't connected
    for low, high, recall in ((0.8, 0.85, 0.85), (0.85, 0.9, 0.9), (0.9, 1.0, 0.98), (1.0, 1.1, 1.0)):
        of_bin = [got[i] == got[j] for (i, j), s in pairs.items() if low <= s < high]
        assert len(of_bin) > 1 and sum(of_bin) >= recall * len(of_bin), (low, sum(of_bin), len(of_bin))
    kept = corpus_pipeline.near_dedup(spark, df, None)
    assert kept.columns == df.columns and kept.count() == len(set(got.values()))
    assert len({got[r.doc_id] for r in kept.collect()}) == kept.count()
    assert S.near_copies(df.limit(0)).count() == 0


def test_candidates_are_verified_exactly(spark, monkeypatch):
    """With every pair a candidate the groups are those of all pairs, however they are dealt."""
    monkeypatch.setattr(S, "BLOCK", 2)
    texts = documents()
    sets = sets_of(texts)
    some = [i for i in range(len(texts)) if sets[i]]
    truth = groups(len(texts), [(j, i) for i in some for j in some if j < i and similarity(sets[i], sets[j]) >= 0.8])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = S.wide_fingerprints(df, "doc_id", "text").filter("n > 0").collect()
    node = {r.id: r.node for r in rows}
    members = spark.createDataFrame(sorted({(1, n, 1) for n in node.values()}), "root long, node long, copies long")
    scratch = Scratch(spark, "t")
    links = S.similar_links(scratch, members, S.shingle_sets(df, "doc_id", "text").dropDuplicates(["node"]))
    root = {r.node: r.root for r in components(scratch, links).collect()}
    got = [root.get(node[i], node[i]) for i in some]
    assert len({(a, truth[i]) for a, i in zip(got, some, strict=True)}) == len(set(got)) == len({truth[i] for i in some})
