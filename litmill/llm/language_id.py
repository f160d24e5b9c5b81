"""Operator 4: language identification by interpolated Kneser-Ney character models, one per language.

A text is its lower-cased words (runs of letters), each framed by a start and an end sign; a model predicts every
letter and every end from up to ``ORDER - 1`` signs before it within the word. The n-grams and contexts of all
languages lie in one sorted array of 64-bit hashes per order, beside a matrix of log-probabilities with a column per
language. The language of the lowest cross-entropy per predicted sign wins; ties go to the lower name. A text whose
cross-entropy lies far above what texts of its language show on a calibration fold is rejected; so is one without
letters, which has no language (``und``).

The models are fitted on at most ``sample_rows`` different labelled rows per language, those of the lowest hashed ids, a
fifth of which calibrate the score and the rejection. Every text is then read whole, in the sample as well.

Rows without text, language or id are not learnt from; a null text is ``und``; repeated rows give repeated rows; an
empty table gives an empty result; a table without labels gives ``und`` throughout; ``keep_identified`` carries extra
columns along whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import broadcast_if_small, expose_package, lowest, only, slices

ORDER = 5
SAMPLE_ROWS = 500
SLICE_BYTES, CACHE_CHUNKS = 2 << 20, 250_000
START, END = "\x02", "\x03"
STEP = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
#: Calibration spreads above the mean beyond which a text is rejected, and the least spread in bits, for texts that mix languages.
REJECT_SPREADS, LEAST_SPREAD = 8.0, 0.3
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The runs of letters of a lower-cased text."""
    found = _WORDS(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def _signs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of all framed words in one array, and how many each word has."""
    flat = "".join(f"{START}{w}{END}" for w in words)
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.fromiter(map(len, words), np.int64, len(words)) + 2


def _hashes(signs: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order, the hash of the k signs that end at each position; 0 where the word starts later.
    ``place`` is the position within the word."""
    out, power, at = [], np.uint64(1), np.zeros(len(signs), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):
            back = np.zeros(len(signs), np.uint64)
            back[k - 1 :] = signs[: max(0, len(signs) - k + 1)]
            at = at + (back + np.uint64(1)) * power
            mixed = at ^ (at >> np.uint64(29))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            out.append(np.where(place >= k - 1, (mixed ^ (mixed >> np.uint64(32))) | np.uint64(1), np.uint64(0)))
            power = power * STEP
    return out


@dataclass
class Model:
    """Sorted hash arrays per order; rows of ``grams_logp`` and ``contexts_logw`` are NaN where a language lacks them."""

    languages: list[str]
    base: float
    grams: list[np.ndarray]
    grams_logp: list[np.ndarray]
    contexts: list[np.ndarray]
    contexts_logw: list[np.ndarray]
    sharpness: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None


def _one_language(words: list[str], counts: np.ndarray) -> list[dict]:
    """Per order k: n-gram hashes with their discounted probabilities, context hashes with their back-off weights."""
    signs, sizes = _signs(words)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(signs)) - first
    weight = np.repeat(counts.astype(np.float64), sizes)
    hashes = _hashes(signs, place, ORDER)
    context = [np.full(len(signs), 1, np.uint64)] + [np.concatenate((np.zeros(1, np.uint64), h[:-1])) for h in hashes[:-1]]
    orders = []
    for k in range(1, ORDER + 1):
        valid = place >= max(1, k - 1)  # a start sign is never predicted
        gram, ctx = hashes[k - 1][valid], context[k - 1][valid]
        whole = place[valid] == k - 1  # begins at the start sign: nothing can stand before it
        keys, at, inverse = np.unique(gram, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weight[valid])
        if k < ORDER:  # the number of different signs that stand before
            longer = hashes[k][valid]
            pairs = np.unique(np.stack((gram[~whole], longer[~whole])), axis=1)
            before = np.zeros(len(keys))
            if pairs.shape[1]:
                where, many = np.unique(pairs[0], return_counts=True)
                before[np.searchsorted(keys, where)] = many
            n = np.where(whole[at], n, before)
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        ctx_keys, ctx_of = np.unique(ctx[at], return_inverse=True)
        total = np.bincount(ctx_of, n)
        kinds = np.bincount(ctx_of, n > 0)
        share = np.maximum(n - discount, 0) / total[ctx_of]
        orders.append({"grams": keys, "share": share, "ctx_of": ctx_keys[ctx_of], "contexts": ctx_keys, "left": discount * kinds / total, "lower": hashes[k - 2][valid][at] if k > 1 else None})
    return orders


def fit(words: pd.DataFrame) -> Model:
    """A model of rows (lang, word, n)."""
    languages = sorted(words["lang"].unique())
    alphabet = len(set("".join(words["word"]))) + 2
    model = Model(languages, float(-np.log2(alphabet)), [], [], [], [])
    each = [_one_language(list(part["word"]), part["n"].to_numpy()) for _, part in ((x, words[words["lang"] == x]) for x in languages)]
    lower: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(ORDER):
        grams = np.unique(np.concatenate([x[k]["grams"] for x in each]))
        contexts = np.unique(np.concatenate([x[k]["contexts"] for x in each]))
        logp = np.full((len(grams), len(languages)), np.nan, np.float32)
        logw = np.full((len(contexts), len(languages)), np.nan, np.float32)
        following = []
        for column, orders in enumerate(each):
            x = orders[k]
            weight = x["left"][np.searchsorted(x["contexts"], x["ctx_of"])]
            if k:
                keys, p = lower[column]
                below = p[np.searchsorted(keys, x["lower"])]
            else:
                below = 1 / alphabet
            p = x["share"] + weight * below
            logp[np.searchsorted(grams, x["grams"]), column] = np.log2(p)
            logw[np.searchsorted(contexts, x["contexts"]), column] = np.log2(np.maximum(x["left"], 1e-12))
            following.append((x["grams"], p))
        lower = following
        model.grams.append(grams)
        model.grams_logp.append(logp)
        model.contexts.append(contexts)
        model.contexts_logw.append(logw)
    return model


class Scorer:
    """Adds up log-probabilities; a word is looked up once while it is in the cache."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages) + 1))
        self.used = 0

    def _log2(self, words: list[str]) -> np.ndarray:
        """Rows (bits per language ..., signs) of words."""
        m = self.model
        signs, sizes = _signs(words)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(signs)) - np.repeat(starts, sizes)
        hashes = _hashes(signs, place, ORDER)
        longest = np.minimum(place, ORDER - 1)  # of the n-gram that ends here, less one
        full = np.choose(longest, hashes)
        _, at, inverse = np.unique(full, return_index=True, return_inverse=True)
        before = np.maximum(at - 1, 0)
        logp = np.full((len(at), len(m.languages)), m.base)
        for k in range(ORDER):
            here = longest[at] >= k
            gram, context = hashes[k][at], hashes[k - 1][before] if k else np.full(len(at), 1, np.uint64)
            g = np.minimum(np.searchsorted(m.grams[k], gram), len(m.grams[k]) - 1)
            c = np.minimum(np.searchsorted(m.contexts[k], context), len(m.contexts[k]) - 1)
            seen = np.where(((m.grams[k][g] == gram) & here)[:, None], m.grams_logp[k][g], np.nan)
            back = np.where(((m.contexts[k][c] == context) & here)[:, None], m.contexts_logw[k][c], np.nan)
            logp = np.where(np.isnan(seen), logp + np.where(np.isnan(back), 0, back), seen)
        bits = logp[inverse]
        bits[starts] = 0  # start signs are not predicted
        return np.concatenate((np.add.reduceat(bits, starts, axis=0), sizes[:, None] - 1), axis=1)

    def _learn(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 20_000):
            part = chunks[i : i + 20_000]
            split = [words_of(c) for c in part]
            many = np.fromiter(map(len, split), np.int64, len(split))
            rows = np.zeros((len(part), self.table.shape[1]))
            if words := [w for ws in split for w in ws]:
                some = np.flatnonzero(many)
                rows[some] = np.add.reduceat(self._log2(words), (np.cumsum(many) - many)[some], axis=0)
            while self.used + len(part) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[self.used : self.used + len(part)] = rows
            self.index.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Rows (bits per language ..., signs) of texts. Words are looked up with what stands around them up to
        white space, for which no pattern is needed."""
        split = [t.lower().split() for t in texts]
        if self.used > CACHE_CHUNKS:
            self.index, self.used, self.table = {}, 0, self.table[:1024]
        new = set()
        for chunks in split:
            new.update(chunks)
        self._learn([c for c in new if c not in self.index])
        many = np.fromiter(map(len, split), np.int64, len(split))
        out = np.zeros((len(texts), self.table.shape[1]))
        if some := np.flatnonzero(many).tolist():
            at = np.fromiter(map(self.index.__getitem__, (c for chunks in split for c in chunks)), np.int64, int(many.sum()))
            out[some] = np.add.reduceat(self.table[at], (np.cumsum(many) - many)[some], axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, score, bits per sign, rejected) of texts."""
        m = self.model
        rows = self.texts(texts)
        n = rows[:, -1]
        some = n > 0
        cross = -rows[:, :-1] / np.maximum(n, 1)[:, None]
        best = cross.argmin(axis=1)
        low = cross[np.arange(len(texts)), best]
        score = np.where(some, 1 / np.exp(-m.sharpness * (cross - low[:, None])).sum(axis=1), 0.0)
        rejected = ~some
        if m.mean is not None:
            limit = m.mean[best] + REJECT_SPREADS * np.sqrt(m.spread[best] ** 2 + m.noise[best] ** 2 / np.maximum(n, 1))
            rejected = rejected | (low > limit)
        return np.where(some, best, -1), score, np.where(some, low, np.nan), rejected


def calibrate(model: Model, texts: pd.DataFrame) -> Model:
    """Sets the score's sharpness and the rejection limits from rows (lang, text) that the models were not fitted on."""
    scorer = Scorer(model)
    rows = scorer.texts(list(texts["text"])) if len(texts) else np.zeros((0, len(model.languages) + 1))
    n = rows[:, -1]
    own = np.array([model.languages.index(x) if x in model.languages else -1 for x in texts["lang"]], np.int64)
    keep = (n > 0) & (own >= 0)
    rows, n, own = rows[keep], n[keep], own[keep]
    cross = -rows[:, :-1] / np.maximum(n, 1)[:, None]
    if len(own):
        rival = cross - cross.min(axis=1, keepdims=True)
        losses = {s: -np.log(np.maximum(np.exp(-s * rival[np.arange(len(own)), own]) / np.exp(-s * rival).sum(axis=1), 1e-12)).mean() for s in 2.0 ** np.arange(0, 7)}
        model.sharpness = min(losses, key=losses.get)
    mine = cross[np.arange(len(own)), own]
    typical, wide = (float(mine.mean()), float(mine.std())) if len(mine) else (-model.base, 1.0)
    shape = (len(model.languages),)
    model.mean, model.spread, model.noise = np.full(shape, typical), np.full(shape, max(wide, LEAST_SPREAD)), np.full(shape, 3.0)
    for i in range(len(model.languages)):
        if (x := mine[own == i]).size >= 20:
            model.mean[i], model.spread[i] = x.mean(), max(x.std(), LEAST_SPREAD)
    return model


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model | None:
    """Models of the languages of ``docs``, from the rows that ``learn`` allows (all labelled rows if None)."""
    labelled = docs.filter(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull() & F.col(id_column).isNotNull())
    labelled = labelled.filter(learn) if learn is not None else labelled
    labelled = labelled.select(F.col(lang_column).alias("lang"), F.xxhash64(F.col(id_column).cast("string")).alias("h"), F.xxhash64(text_column).alias("t"), F.col(text_column).alias("text"))
    chosen = lowest(labelled.select("lang", "h", "t"), sample_rows, ["lang"])
    limits = chosen.groupBy("lang").agg(F.max(F.struct("h", "t")).alias("top"))
    limits = docs.sparkSession.createDataFrame(limits.select("lang", "top.h", "top.t").collect(), "lang string, top_h long, top_t long")  # a row for each language
    sample = labelled.join(broadcast_if_small(limits, limits.count()), "lang").filter("struct(h, t) <= struct(top_h, top_t)")
    sample = sample.groupBy("lang", "h", "t").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: Counter = Counter()
        for batch in batches:
            for lang, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not fold:
                    counts.update((lang, w) for w in words_of(text.lower()))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    sample = sample.withColumn("fold", F.pmod("h", F.lit(5)) == 0)
    words = sample.select("lang", "fold", "text").filter("NOT fold").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    if words.empty:
        return None
    return calibrate(fit(words.sort_values(["lang", "word"])), sample.filter("fold").select("lang", "text").toPandas())


class _Held:
    """A broadcast and its id."""

    def __init__(self, sent, key: str):
        self.sent, self.id = sent, key

    @property
    def value(self):
        return self.sent.value


def _send(docs: DataFrame, model: Model) -> _Held:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return _Held(sent, uuid.uuid4().hex)


def _predicted(held: _Held, text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    scorer = only(("language", held.id), lambda: Scorer(held.value))
    text = pc.fill_null(text, "")
    parts = [scorer.predict(text.slice(i, j - i).to_pylist()) for i, j in slices(text, SLICE_BYTES)]
    which, score, bits, rejected = (np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts, strict=True) if parts else [()] * 4))
    names = np.array([*held.value.languages, UNKNOWN], object)
    return pa.array(names[which.astype(np.int64)], pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64(), from_pandas=True), pa.array(rejected.astype(bool))


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, bits (cross-entropy per sign, null without letters), rejected."""
    expose_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_column), "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    held = _send(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_predicted(held, batch.column(2))], ["id", "held_out", "lang_pred", "score", "bits", "rejected"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, bits double, rejected boolean")
    return out.withColumnRenamed("id", id_column)


def keep_identified(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns. Without a model nothing can be identified."""
    expose_package(docs.sparkSession)
    if model is None:
        return docs.filter(F.lit(False))
    held, at = _send(docs, model), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.invert(_predicted(held, batch.column(at))[3]))

    return docs.mapInArrow(run, docs.schema)
