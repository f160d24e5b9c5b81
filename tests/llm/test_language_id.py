import numpy as np
import pandas as pd

from litmill.llm import language_id as L
from litmill.llm.common import lowest

WORDS = {"en": "the knee was then treated with this other method and there they saw those results again".split(), "de": "das knie wurde dann mit dieser anderen methode behandelt und dort sahen sie jene ergebnisse wieder".split()}


def _docs(spark, n=240):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 30)).capitalize() + ".", lang, "src") for i in range(n) for lang in [("en", "de")[i % 2]]]
    rows += [(9001, None, "en", None), (9002, "12 34!", None, None), (9003, "", "de", None), (None, "the knee was treated", "en", None), (9004, "the knee", None, None), (9004, "the knee", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("source", "lang_pred")


def test_held_out_accuracy(spark):
    docs = _docs(spark)
    got = L.identify(docs, L.train(docs, ~L.held_out())).toPandas()
    assert len(got) == 246
    labelled = docs.select("doc_id", "lang").toPandas()
    joined = got.merge(labelled[labelled.doc_id < 1000], on="doc_id")
    assert (joined[joined.held_out].lang_pred == joined[joined.held_out].lang).mean() > 0.97 and joined.held_out.sum() > 50
    assert set(got[got.doc_id.isin([9001, 9002, 9003])].lang_pred) == {"und"} and got.score.between(0, 1).all()
    assert not joined.rejected.any() and got[got.doc_id == 9002].rejected.all()
    assert (got[got.doc_id == 9004].lang_pred == "en").all() and not got[got.doc_id.isna()].held_out.any()


def test_without_labels_or_rows(spark):
    docs = _docs(spark, 0)
    assert L.train(docs.filter("lang = 'xx'")) is None
    assert set(L.identify(docs, None).toPandas().lang_pred) == {"und"} and L.keep_identified(docs, None).count() == 0
    assert L.identify(docs.limit(0), None).count() == 0


def test_keep_identified(spark):
    docs = _docs(spark)
    rows = spark.createDataFrame([(1, "xqzzv kwpfj qxjw zzkq " * 20, "en", None), (2, "the knee was treated with this method", "en", None), (3, None, None, None)], docs.schema)
    kept = L.keep_identified(rows, L.train(docs))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_probabilities_add_up():
    words = pd.DataFrame([("en", w, 3) for w in WORDS["en"]] + [("de", w, 2) for w in WORDS["de"]], columns=["lang", "word", "n"])
    model = L.fit(words.drop_duplicates())
    scorer = L.Scorer(model)
    signs = sorted({c for w in words["word"] for c in w})
    for prefix in ("", "t", "th", "the", "knee", "zz"):
        own = scorer._log2([prefix + c for c in signs]) if prefix else scorer._log2(signs)
        total = np.zeros(2)
        for c, row in zip(signs, own, strict=True):
            end = scorer._log2([prefix + c])[0]
            both = _prefix_bits(scorer, prefix + c)
            total += 2 ** (both - _prefix_bits(scorer, prefix))
            assert np.allclose(end, row)
        total += 2 ** (scorer._log2([prefix])[0][:2] - _prefix_bits(scorer, prefix)) if prefix else 0
        assert (total < 1 + 1e-6).all() and (total > 0.9 if prefix not in ("zz",) else total > 0.5).all()


def _prefix_bits(scorer, prefix):
    """Bits of the letters of a prefix, without the end."""
    if not prefix:
        return np.zeros(2)
    m = scorer.model
    signs = np.array([ord(L.START), *map(ord, prefix)], np.uint64)
    hashes = L._hashes(signs, np.arange(len(signs)), L.ORDER)
    total = np.zeros(2)
    for i in range(1, len(signs)):
        logp = np.full(2, m.base)
        for k in range(min(i + 1, L.ORDER)):
            context = hashes[k - 1][i - 1] if k else np.uint64(1)
            g, c = np.searchsorted(m.grams[k], hashes[k][i]), np.searchsorted(m.contexts[k], context)
            seen = m.grams_logp[k][g] if g < len(m.grams[k]) and m.grams[k][g] == hashes[k][i] else np.full(2, np.nan)
            back = m.contexts_logw[k][c] if c < len(m.contexts[k]) and m.contexts[k][c] == context else np.full(2, np.nan)
            logp = np.where(np.isnan(seen), logp + np.nan_to_num(back), seen)
        total += logp
    return total


class Counted:
    """Interpolated Kneser-Ney probabilities of framed words, from dictionaries."""

    def __init__(self, words, alphabet):
        self.base = 1 / alphabet
        raw, before = [{} for _ in range(L.ORDER + 1)], [{} for _ in range(L.ORDER + 1)]
        for word, n in words.items():
            s = L.START + word + L.END
            for i in range(1, len(s)):
                for k in range(1, min(L.ORDER, i + 1) + 1):
                    gram = s[i - k + 1 : i + 1]
                    raw[k][gram] = raw[k].get(gram, 0) + n
                    if i - k >= 0:
                        before[k].setdefault(gram, set()).add(s[i - k])
        self.n = [{}] + [{g: n if k == L.ORDER or g[0] == L.START else len(before[k][g]) for g, n in raw[k].items()} for k in range(1, L.ORDER + 1)]
        self.context = [{} for _ in self.n]
        self.discount = [0.0]
        for k in range(1, L.ORDER + 1):
            once, twice = (sum(v == x for v in self.n[k].values()) for x in (1, 2))
            self.discount.append(once / (once + 2 * twice) if once and twice else 0.5)
            for gram, n in self.n[k].items():
                total, kinds = self.context[k].get(gram[:-1], (0, 0))
                self.context[k][gram[:-1]] = (total + n, kinds + (n > 0))

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else self.base
        if gram[:-1] not in self.context[k]:
            return lower
        total, kinds = self.context[k][gram[:-1]]
        d = self.discount[k]
        return max(self.n[k].get(gram, 0) - d, 0) / total + d * kinds / total * lower

    def bits(self, word):
        s = L.START + word + L.END
        return sum(np.log2(self.p(s[max(0, i - L.ORDER + 1) : i + 1])) for i in range(1, len(s)))


def test_probabilities_by_brute_force():
    rng = np.random.default_rng(3)
    make = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 9)))
    counts = {lang: {make(letters): int(rng.integers(1, 6)) for _ in range(300)} for lang, letters in (("aa", "abcdefé"), ("bb", "cdefghß"))}
    words = pd.DataFrame([(lang, w, n) for lang, ws in counts.items() for w, n in ws.items()], columns=["lang", "word", "n"])
    model = L.fit(words)
    own = [Counted(counts[lang], len(set("".join(words["word"]))) + 2) for lang in model.languages]
    scorer = L.Scorer(model)
    asked = [make("abcdefghéßz") for _ in range(300)] + list(counts["aa"])[:50] + ["ü", "zzzzzzzzzz"]
    got = scorer._log2(asked)
    for word, row in zip(asked, got, strict=True):
        assert np.allclose(row[:2], [c.bits(word) for c in own], atol=1e-3) and row[2] == len(word) + 1
    texts = [" ".join(asked[i : i + 5]) + "!" for i in range(0, 300, 5)]
    best, *_ = scorer.predict(texts)
    want = [int(np.argmax([sum(c.bits(w) for w in t[:-1].split()) for c in own])) for t in texts]
    assert best.tolist() == want


def test_sample_is_bounded_and_whole(spark):
    """Many rows of one id don't make the sample grow, and equal rows count once."""
    rows = [(1, f"the knee number {i}", "en") for i in range(300)] + [(2, "das knie", "de")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.train(docs, sample_rows=7) is not None
    low = lowest(docs.selectExpr("lang", "xxhash64(cast(doc_id as string)) AS h", "xxhash64(text) AS t"), 7, ["lang"]).collect()
    assert sorted(r.lang for r in low) == ["de"] + ["en"] * 7
