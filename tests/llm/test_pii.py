import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from litmill.llm import pii as P

TEXT = (
    "mail bosbt.42@mail8.example.com card 4041 8949 7460 8795 no 4041894974608795. call +1 (456) 555-2186 or (456) 555-2186, 42.144.35.254; 999.1.1.1 "
    "ssn 123-45-6789 000-11-2222 born 1980-02-29 1981-02-29 31.12.1999 12/31/1999 GB82 WEST 1234 5698 7654 32 DE89370400440532013000 ok 4242424242424241 é😀"
)


def luhn(d):
    return sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def feistel(left, right, a, b, tweak):
    for n in range(1, P.ROUNDS + 1):
        half = right if n % 2 else left
        h = int(hashlib.sha256(f"k|{tweak}|{n}|{half}".encode()).hexdigest()[:12], 16)
        left, right = ((left + h) % a, right) if n % 2 else (left, (right + h) % b)
    return left, right


def test_feistel_is_the_permutation(spark):
    for a, b in ((7, 11), (189, 773), (1, 5)):
        z = spark.range(a * b).select("id", P.feistel(F.floor(F.col("id") / b), F.col("id") % b, a, b, "t", "k").alias("x"))
        got = {r.id: (r.x.l, r.x.r) for r in z.collect()}
        assert len(set(got.values())) == a * b and all(0 <= x < a and 0 <= y < b for x, y in got.values())
        assert all(got[i] == feistel(i // b, i % b, a, b, "t") for i in range(0, a * b, 97))


def test_text(spark):
    rows = [(1, TEXT, 0), (2, None, 0), (3, "", 0), (4, "again 4041894974608795 and 4041-8949-7460-8795", 0), (4, "again 4041894974608795 and 4041-8949-7460-8795", 0), (None, "no number", 0), (5, "x 42.144.35.254 " * 3000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pii int")
    got = P.pseudonymise(df, "k").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    one = by[1]
    assert (one.n_email, one.n_card, one.n_iban, one.n_ssn, one.n_phone, one.n_ip, one.n_date, one.n_pii) == (1, 2, 2, 1, 2, 1, 3, 12)
    assert [re.sub("[A-Za-z0-9]", "#", w) if re.search("[0-9]", w) else w for w in one.text.split()] == [re.sub("[A-Za-z0-9]", "#", w) if re.search("[0-9]", w) else w for w in TEXT.split()] or "." in one.text
    for gone in ("bosbt.42@", "4041894974608795", "555-2186", "42.144.35.254", "123-45-6789", "1980-02-29", "31.12.1999", "1234 5698"):
        assert gone not in one.text
    for stays in ("999.1.1.1", "000-11-2222", "1981-02-29", "4242424242424241", "@mail8.example.com", "é😀"):
        assert stays in one.text
    card = re.search(r"no (\d{16})\.", one.text)[1]
    assert luhn(card) and one.text.count(card) == 1 and re.search(r"card ((?:\d{4} ){3}\d{4})", one.text)[1].replace(" ", "") == card
    assert by[4].text == f"again {card} and {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}"
    iban = re.search(r"DE\d{20}", one.text)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert by[2].text is None and by[2].n_pii == 0 and by[3].text == "" and by[None].text == "no number" and by[5].n_ip == 3000
    other = P.pseudonymise(df.filter("doc_id = 4"), "other").first()
    assert card not in other.text
    assert P.pseudonymise(df.limit(0)).count() == 0 and spark.conf.get(P.KEY_SETTING)


@pytest.mark.parametrize("kind", ["card", "ssn", "phone", "date", "ip", "email"])
def test_different_values_stay_different(spark, kind):
    make = {
        "card": lambda i: (lambda h: h + str(next(c for c in range(10) if luhn(h + str(c)))))(f"{400000000000000 + i:015d}"), "ssn": lambda i: f"{1 + i % 600:03d}-{1 + i % 90:02d}-{1 + i:04d}", "phone": lambda i: f"({200 + i % 700}) {200 + i % 790}-{i:04d}",
        "date": lambda i: f"{1900 + i // 28:04d}-02-{1 + i % 28:02d}", "ip": lambda i: f"10.{i % 250}.{i // 250}.7", "email": lambda i: f"ab{i:04d}@x.org",
    }[kind]
    values = sorted({make(i) for i in range(1500)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    got = [r.text for r in P.pseudonymise(df, "k").collect()]
    assert len(set(got)) == len(values) and P.pseudonymise(df, "k").agg(F.sum(f"n_{kind}")).first()[0] == len(values)


def cards(run):
    """The cards of a run of digit groups, as (first group, last group)."""
    groups = re.split("[ -]", run)
    form = lambda g: len(g) == 1 or [len(x) for x in g] in ([4, 6, 4], [4, 6, 5]) or (len(g) in (4, 5) and [len(x) for x in g[:3]] == [4] * 3 and (len(g) == 4 and len(g[3]) <= 4 or len(g) == 5 and len(g[3]) == 4 and len(g[4]) <= 3))
    found = []
    for size in P.CARD_LENGTHS:
        for i in range(len(groups)):
            for j in range(i + 1, len(groups) + 1):
                digits = "".join(groups[i:j])
                if len(digits) == size and form(groups[i:j]) and luhn(digits) and set(digits) != {"0"} and all(j <= a or i >= b for a, b in found):
                    found.append((i, j))
    return sorted(found)


def valid_card(rng, size=16):
    head = "".join(rng.choice("123456789") for _ in range(size - 1))
    return head + next(str(c) for c in range(10) if luhn(head + str(c)))


def test_cards_by_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 9)):
            size = rng.choice([13, 14, 15, 16, 16, 16, 19])
            digits = valid_card(rng, size) if rng.random() < 0.6 else "".join(rng.choice("0123456789") for _ in range(size))
            sep = rng.choice(["", " ", "-"])
            parts.append(sep.join(digits[i : i + 4] for i in range(0, size, 4)) if size != 15 else sep.join((digits[:4], digits[4:10], digits[10:])))
            if rng.random() < 0.5:
                parts.append("".join(rng.choice("0123456789") for _ in range(rng.randint(1, 4))))
        texts.append("x " + "".join(p + rng.choice([" ", "-", " ", ", "]) for p in parts) + "y")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for r in P.pseudonymise(df, "k").collect():
        before, after = texts[r.doc_id], r.text
        assert re.sub("[0-9]", "#", before) == re.sub("[0-9]", "#", after)
        if r.n_pii != r.n_card:
            continue
        want = 0
        for m in re.finditer("[0-9](?:[ -]?[0-9]){12,}", before):
            found = cards(m[0])
            want += len(found)
            old, new = re.split("[ -]", m[0]), re.split("[ -]", after[m.start() : m.end()])
            for i, j in found:
                assert luhn("".join(new[i:j])) and new[i:j] != old[i:j]
            assert all(new[i] == old[i] for i in range(len(old)) if not any(a <= i < b for a, b in found))
        assert r.n_card == want
        n += want
    assert n > 500


def test_valid_values_beside_others(spark):
    texts = ["order 12 4111111111111111", "id 7 4111 1111 1111 1111", "4111111111111111 12/24", "4111-1111-1111-1111 123", "DE00 4111 1111 1111 1111 x", "AT61 1904 3002 3457 3201 2021", "ES9121000418450200051332 EUR", "call +49 30 1234 5678", "\ufdd0 1.2.3.4 \ufdd5"]
    got = [r for r in P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert [(r.n_card, r.n_iban, r.n_phone, r.n_ip) for r in got] == [(1, 0, 0, 0)] * 5 + [(0, 1, 0, 0)] * 2 + [(0, 0, 1, 0), (0, 0, 0, 1)]
    assert len({re.sub("[^0-9]", "", r.text)[-16:] for r in got[:1]} | {re.sub("[^0-9]", "", got[1].text)[-16:]}) == 1
    assert got[5].text.endswith(" 2021") and got[6].text.endswith(" EUR") and got[8].text.startswith("\ufdd0 ") and got[8].text.endswith(" \ufdd5")
