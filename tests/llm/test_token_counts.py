import random

import pytest

from litmill.llm.queries import tokenizer_path
from litmill.llm.token_counts import BpeCounter, token_counts

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", "a", " ", "  x", "x  ", "aaaaaaa", "aaaa aaaa", "don't 's  it's \"'s", "<|endoftext|>a<|endoftext|>  b", "\x1c!\x1c a　　 b", "日本語 12345", "\n\n a\n", "x" * 3000, "🙂🙂 é́", "٣٤ ½ ²"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_counts_are_the_librarys(library):
    counter, rng = BpeCounter(tokenizer_path("byte_bpe_50k.json")), random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é'st\n .,1🙂re") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "knee " * 600, 1), (3, "é", 2)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(df, tokenizer_path("byte_bpe_50k.json")).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3000, got[-1][2] if got[-1][0] is None else 1201, True), (3, 2, 1, False)], key=str)
    assert token_counts(df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0
