import random
import zlib

import numpy as np
import pytest

from litmill.llm import repair as R
from litmill.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = tokenizer_path("word_bpe_49k.json")
ODD = [
    None, "", "a", "  x", "don't IT'S DON'T, 's", "<|endoftext|>a<|ENDOFTEXT|>. b <|startoftext|>", "\x1c!\x1c a　　 b. c", "日本語 テスト 12345", "x" * 3000, "🙂🙂 é́ Σας ΣΑΣ İ", "THE, The. the.. éa. É, AB́. J̌.", "., ,. . a.\nb, ...", "a\x01b \x01 c", "٣٤ ½ ²",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(["knee ", "Joint, ", "é. ", "\n", "'s ", "12", "!.", " ", "the "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]


def test_ids_are_the_librarys(library):
    own = R.Encoder(VOCABULARY)
    rows = [(t or "").encode() for t in texts()]
    ids, many = own.encode(rows, 1)
    for got, t in zip(np.split(ids, np.cumsum(many)[:-1]), texts(), strict=True):
        assert got.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_encode_whole_texts(name):
    own, library = R.Encoder(tokenizer_path(name)), tokenizers.Tokenizer.from_file(tokenizer_path(name))
    assert not own.piecewise and R.Encoder(VOCABULARY).piecewise
    ids, many = own.encode([(t or "").encode() for t in texts()], 1)
    for got, t in zip(np.split(ids, np.cumsum(many)[:-1]), texts(), strict=True):
        assert got.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]


def pair_counts(symbols):
    """How often each pair stands in a list, of overlapping places the left one."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = i
    return counts


def test_round_trip_and_spans():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 5000, 60_000):
        ids = (rng.zipf(1.3, n) % 500).astype(np.uint16)
        for data in (ids, np.full(n, 7, np.uint16), (rng.integers(0, 1 << 20, n) * 4000).astype(np.uint32)):
            alphabet, rules, rounds, symbols = R.compress(data)
            shard = R.Shard(alphabet, rules, rounds, symbols)
            assert (shard.ids() == data).all() and int(rounds.sum()) == len(rules) and R.rule_lengths(len(alphabet), rules, rounds).tolist() == shard.size[len(alphabet) :].tolist()
            for a, b in rng.integers(0, n + 1, (20, 2)):
                assert (shard.span(min(a, b), max(a, b)) == data[min(a, b) : max(a, b)]).all()
    assert len(R.compress(np.tile(np.arange(10, dtype=np.uint16), 1000))[3]) < 40


def test_grammar_by_brute_force(monkeypatch):
    """With one pair a round the rules are those of Re-Pair; with more, what is left is no more frequent."""
    rng = np.random.default_rng(2)
    for n in (200, 1000):
        data = (rng.zipf(1.5, n) % 12).astype(np.uint16)
        with monkeypatch.context() as m:
            m.setattr(R, "STEEP", 1)
            alphabet, rules, rounds, symbols = R.compress(data)
        own, level = [int(np.searchsorted(alphabet, x)) for x in data], 0
        for k in rounds.tolist():
            counts = {}
            for pair in zip(own, own[1:], strict=False):
                counts[pair] = counts.get(pair, 0) + 1
            chosen = {tuple(r): len(alphabet) + level + i for i, r in enumerate(rules[level : level + k].tolist())}
            assert {counts[p] for p in chosen} == {max(counts.values())} and max(counts.values()) >= R.LEAST_COUNT
            out, i = [], 0
            while i < len(own):
                pair = tuple(own[i : i + 2])
                out.append(chosen.get(pair, own[i]))
                i += 2 if pair in chosen else 1
            own, level = out, level + k
        assert own == symbols.tolist()
        for steep in (1, 16):
            monkeypatch.setattr(R, "STEEP", steep)
            left = pair_counts(R.compress(data)[3].tolist())
            assert max(left.values()) < R.LEAST_COUNT


def test_more_symbols_than_16_bits(monkeypatch):
    monkeypatch.setattr(R, "LEAST_COUNT", 2)
    rng = np.random.default_rng(3)
    words = rng.integers(0, 65_000, (40_000, 4)).astype(np.uint16)
    data = words[rng.permutation(np.repeat(np.arange(40_000), 3))].ravel()
    alphabet, rules, rounds, symbols = R.compress(data)
    assert symbols.itemsize == 4 and len(alphabet) + len(rules) > 1 << 16 and (R.Shard(alphabet, rules, rounds, symbols).ids() == data).all()


def test_file(spark, library, monkeypatch):
    monkeypatch.setattr(R, "SHARD_IDS", 500)
    rows = [(i * 3, t, i) for i, t in enumerate(texts())] + [(6, "again", 0), (None, "nobody's", 0), (None, None, 0)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted(R.write_and_read(df, VOCABULARY).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = {}
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r.start == start
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert not any(want.values()) and R.write_and_read(df.limit(0), VOCABULARY).count() == 0
