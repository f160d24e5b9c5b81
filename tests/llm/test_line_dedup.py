import random

import numpy as np
import pytest
import xxhash

from litmill.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(following[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def simhash(line):
    masked = line.translate(str.maketrans("123456789", "000000000"))
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(masked.split(" "))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def documents():
    rng = random.Random(1)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(lines).split(" ")
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] += "x"
            own.append(rng.choice(["", " ", "\t"]) + "  ".join(line).upper())
        rows.append((i, "\n".join(own), "keep", "a"))
    rows += [(200 + i, f"2024-01-{i % 28 + 1:02d} user {i * 7919 % 1000:03d} logged in from {i * 31 % 250}.{i * 17 % 250}.1.1 with a code {i * 104729 % 10**9:09d}", "log", "a") for i in range(60)]
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_000))
    rows += [(100, None, "k", "a"), (101, "", "k", "a"), (102, "A b\nc  D e\n\nc d e", "k", "a"), (None, "c d\te", "k", "a"), (102, "A b\nc  D e\n\nc d e", "k", "b"), (103, "w " * 20000 + "end", "k", "a"), (104, "w " * 20000 + "end\n| a | b | c", "k", "a"), (105, "| x | y | z", "k", "a"), (106, many, "k", "a")]
    return rows


@pytest.mark.parametrize("block", [2048, 3])
def test_groups_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "COUNTED", (1 << 15) - 1 if block > 3 else 20)  # the second way for long lines too
    monkeypatch.setattr(L, "SHORT", 500 if block > 3 else 30)
    monkeypatch.setattr(L, "BESIDE", 32 if block > 3 else 1)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, first_row string")
    lines = sorted({" ".join(line.lower().split()) for _, t, *_ in rows for line in (t or "").split("\n")} - {""})
    fp = {x: simhash(x) for x in lines}
    assert {(r.h % 2**64, r.fp % 2**64) for r in L.hashed_lines(df).collect() if r.size} == {(xxhash.xxh64_intdigest(x.encode(), 42), fp[x]) for x in lines}
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            longer = max(len(a), len(b))
            if (fp[a] ^ fp[b]).bit_count() <= 3 and min(len(a), len(b)) >= 0.8 * longer and distance(a, b) <= np.floor(longer * 0.2 + 1e-9):
                root[find(b)] = find(a)
    groups = {find(x) for x in lines}
    report = L.line_report(df).collect()
    assert len(report) == len(rows) and sum(r.n_kept for r in report) == len(groups) < len(lines)
    assert sorted((r.n_lines for r in report)) == sorted(sum(1 for x in (t or "").split("\n") if x.strip()) for _, t, *_ in rows)
    assert sorted((r.n_lines, r.n_kept) for r in report if r.doc_id == 102) == [(3, 0), (3, 2)]
    kept = L.dedup_lines(df)
    assert kept.columns == df.columns
    after = kept.collect()
    assert sorted((r.doc_id or -1, r.doc, r.first_row) for r in after) == sorted((i or -1, a, b) for i, _, a, b in rows)
    left = [" ".join(x.lower().split()) for r in after for x in (r.text or "").split("\n")]
    assert sorted(find(x) for x in left if x) == sorted(groups)
    assert L.line_report(df.limit(0)).count() == 0 and L.dedup_lines(df.limit(0)).count() == 0


def test_first_by_id(spark):
    rows = [(None, "same line here"), (9, "other\nsame line here"), (4, "x y z\n\nSAME  line here"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.n_kept, r.n_dropped) for r in L.line_report(df).collect()}
    assert got == {(None, 1, 0, 1), (9, 2, 1, 1), (4, 2, 2, 0), (4, 0, 0, 0)}
    assert {(r.doc_id, r.text) for r in L.dedup_lines(df).collect()} == {(None, ""), (9, "other"), (4, "x y z\n\nSAME  line here"), (4, None)}


def test_many_equal_rows(spark):
    """Counters of 16 bits don't run over where a document occurs many times."""
    line = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    df = spark.createDataFrame([(1, line)] * 900 + [(2, line + " more")], "doc_id long, text string")
    got = L.line_report(df).collect()
    assert len(got) == 901 and sum(r.n_kept for r in got) == 1 and {r.n_lines for r in got} == {1}
    assert {r.fp % 2**64 for r in L.hashed_lines(df).collect()} == {simhash(line), simhash(line + " more")}
