import random

from litmill.llm import decontaminate as D

ITEM = "Yesterday in the town Tom bought 3 apples for 12 dollars and later Tom gave 3 apples to his old neighbour Anna near the river"
PLAIN = "a quick study of slow rivers shows that water finds the lowest path between two banks every single time"


def tables(spark):
    docs = [
        (1, "Some words before. " + ITEM + " and words after"), (2, ITEM.replace("Tom", "Bob").replace("3", "7").replace("12", "55").replace("Anna", "Eve")),
        (3, ITEM.replace("Tom bought 3", "Tom bought 9").replace("Tom gave 3", "Bob gave 4").replace("Anna", "Tom")), (4, "nothing of the kind is said in this text at all here"), (5, None), (6, ""),
        (7, "Intro " + " ".join(PLAIN.split()[:14]) + " then it goes on"), (8, " ".join(PLAIN.split()[:9]) + " differs"), (None, PLAIN.upper()), (9, "word " * 30000 + PLAIN),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, row_key string")
    items = spark.createDataFrame([(11, ITEM), (12, PLAIN), (10, PLAIN), (13, None), (14, ""), (15, "the of"), (None, "an item without any id that still has quite a few words")], "item_id long, text string")
    return docs, items


def test_finds_whole_partial_and_changed(spark, monkeypatch):
    docs, items = tables(spark)
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items).collect()}
    assert {k for k in got} == {(1, 11), (2, 11), (7, 10), (None, 10), (9, 10)}
    assert got[1, 11].coverage > 0.9 and got[1, 11].n_exchanged == 0 and got[2, 11].n_exchanged == 4 and got[7, 10].n_items == 2
    assert got[9, 10].first_word == 30000
    for setting, value in (("BROADCAST_ROWS", 0), ("MAP_BITS", 13)):  # a shuffled join, and a map that excludes little
        monkeypatch.setattr(D, setting, value)
        assert {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items).collect()} == got


def test_items_of_one_template(spark):
    other = ITEM.replace("Tom", "Bob").replace("3", "7").replace("12", "55").replace("Anna", "Eve")
    docs = spark.createDataFrame([(1, "x " + ITEM), (1, "x " + ITEM), (2, other)], "doc_id long, text string")
    items = spark.createDataFrame([(13, ITEM), (11, ITEM), (12, other)], "item_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.item_id, r.n_items, r.coverage > 0.9) for r in D.contaminated(docs, items).collect()) == [(1, 11, 3, True), (1, 11, 3, True), (2, 11, 3, True)]


def test_items_with_hardly_a_plain_word(spark):
    docs = ["so what is 3 + 4 * 12 - 7 / 2 ^ 5 then", "so what is 8 + 4 * 12 - 7 / 2 ^ 5 then", "Heute hat Anna Meier Peter Schulz und Hans Otto Kurz Briefe gegeben"]
    items = spark.createDataFrame([(1, "3 + 4 * 12 - 7 / 2 ^ 5"), (2, "Anna Meier Peter Schulz und Hans Otto Kurz Briefe")], "item_id long, text string")
    got = D.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(0, 1), (2, 2)} and all((r.doc_id, r.item_id) != (1, 2) for r in got)


def brute(item, doc):
    """Whether the plain words of an item stand in a text in order, with its slots exchanged one to one throughout."""
    a, b = item.split(), doc.split()
    for start in range(len(b) - len(a) + 1):
        there, back = {}, {}
        for x, y in zip(a, b[start : start + len(a)], strict=True):
            slot = x[0].isupper() or x.isdigit()
            if slot != (y[0].isupper() or y.isdigit()) or x.isdigit() != y.isdigit() or (not slot and x != y):
                break
            if slot and (there.setdefault(x, y) != y or back.setdefault(y, x) != x):
                break
        else:
            return True
    return False


def test_random_templates_by_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    names = ["Tom", "Anna", "Eve", "Bob", "Jim", "Sue", "Kim", "Ned"]

    def item():
        out = [rng.choice(words) for _ in range(rng.randint(12, 30))]
        slots = [rng.choice(names) for _ in range(2)] + [str(rng.randint(10, 99)) for _ in range(2)]
        for slot in slots:
            for _ in range(rng.randint(1, 2)):
                out[rng.randrange(1, len(out))] = slot
        return out

    items = [item() for _ in range(30)]
    docs = []
    for i in range(200):
        body = list(items[i % 30])
        slots = sorted({w for w in body if w[0].isupper() or w.isdigit()})
        if i % 3 == 1:  # exchanged throughout
            fresh_names, fresh_numbers = iter(rng.sample(names, len(names))), iter(rng.sample(range(100, 999), 20))
            new = {s: next(fresh_names) if s[0].isupper() else str(next(fresh_numbers)) for s in slots}
            body = [new.get(w, w) for w in body]
        elif i % 3 == 2:
            body = [rng.choice(words) for _ in body]
        docs.append(" ".join([rng.choice(words) for _ in range(10)] + body + [rng.choice(words) for _ in range(10)]))
    want = {(d, k) for d, text in enumerate(docs) for k, x in enumerate(items) if brute(" ".join(x), text)}
    first = {k: min(j for j in range(30) if brute(" ".join(items[k]), " ".join(items[j])) and brute(" ".join(items[j]), " ".join(items[k]))) for k in range(30)}
    found = D.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, first[k]) for d, k in want} and len(want) > 120


def test_keep_clean(spark):
    docs, items = tables(spark)
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert D.keep_clean(docs, items.limit(0)).count() == docs.count() and D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), items).count() == 0


def test_windows_by_brute_force():
    t = D.Templates()
    (words,), many, hashes, kinds, plain = t.words([ITEM + " " + ITEM + " Tom Bob 3 4 5 dollars x"])
    own = D.window_hashes(hashes, kinds, plain, many, 5)
    few = [sum(k == 0 for k in kinds[i : i + 5]) < D.MIN_LITERALS for i in range(len(words))]
    assert [bool(x) for x in own] == [i + 5 <= len(words) for i in range(len(words))]
    key = [(tuple(words[i : i + 5]) if few[i] else tuple(hashes[i : i + 5].tolist()), int(own[i])) for i in range(len(words) - 4)]
    assert len({a for a, _ in key}) == len({b for _, b in key}) == len(set(key))


def test_occurrences_that_follow_each_other(spark):
    one = ITEM.replace("Tom", "Bob").replace("3", "7").replace("12", "55").replace("Anna", "Eve")
    two = ITEM.replace("Tom", "Jim").replace("3", "8").replace("12", "44").replace("Anna", "Sue")
    longer = ITEM.replace("and later", "and a little later")
    bad = ITEM.replace("Tom bought 3", "Tom bought 9").replace("Tom gave 3", "Bob gave 4").replace("Anna", "Tom")
    texts = [f"{ITEM} {one}", f"{one} {ITEM}", f"{one} {two}", f"{one} {two} {ITEM}", f"{longer} {one}", f"{one} {longer} {two}", f"{bad} {bad}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(11, ITEM), (12, one)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.contaminated(docs, items).collect()) == [0, 1, 2, 3, 4, 5]
    assert [r.doc_id for r in D.keep_clean(docs, items).collect()] == [6]
