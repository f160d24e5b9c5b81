"""Operator 8: benchmark decontamination by template windows.

Words are lower-cased and stripped of punctuation; numbers, names (capitalised words within a sentence) and units
after a number become typed placeholders. Every window of ``WINDOW`` template words of the benchmark and of the documents
has a hash; a window of fewer than ``MIN_LITERALS`` words that are not placeholders can't be told from ordinary text, so
the hash is that of its very words. Both window tables are joined by hash. Windows that match an item's are aligned; what
stands in an item's slot must map one to one to what stands there in the document: if the mapping of most holds for less
than ``MIN_CONSISTENT`` of the places the match is dropped, and windows that break it do not count. Each occurrence of an
item is judged by itself, also where others follow closely. A document is contaminated by an item if windows that count
cover ``MIN_COVERAGE`` of the item's words. So an item is found whole, in good part, and with its numbers, names or units
exchanged throughout; one with hardly a plain word is found as it is.

Items of the same template and the same pattern of equal slots are one: reported is the lowest id and how many there
are. Items of fewer than ``WINDOW`` words are one window of their own length; those of fewer than ``MIN_LITERALS`` words
match nothing.

Before the join, windows of documents are looked up in a bit map of all hashes of the benchmark, whose size is fixed
(``MAP_BITS``); it decides nothing, so a benchmark that fills it costs time and no result. The window table of the benchmark
is broadcast up to ``BROADCAST_ROWS`` rows and shuffled beyond.

Null texts and items match nothing; texts are read whole; repeated documents give repeated rows; an item without id is
reported as null; extra columns are carried along by ``keep_clean`` whatever their names; an empty table of either kind
gives an empty result, or keeps all documents.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import BROADCAST_ROWS, Scratch, expose_package, keys_to_join, only, row_key, slices, unused

WINDOW, MIN_LITERALS, MIN_COVERAGE, MIN_CONSISTENT = 8, 4, 0.5, 0.8
#: Bits of the map of the benchmark's hashes: 8 MB.
MAP_BITS = 26
SLICE_BYTES, CACHE_WORDS = 2 << 20, 200_000
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Number words and unit words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degrees celsius fahrenheit kb mb gb tb hz khz mhz ghz watt watts volt volts"
).split()
STRIP = ".,;:!?\"'()[]{}<>*#%&$|/\\-_=+~`^@…“”‘’«»¿¡"
ENDS = (".", "!", "?", ":", "…")


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


class Templates:
    """Turns texts into template hashes; what is known of a word is looked up once while it is in the cache."""

    placeholder = np.array([0, *(_mix(i) for i in (11, 12, 13))], np.uint64)

    def __init__(self):
        self.index: dict[str, int] = {}
        self.hash = np.zeros(1024, np.uint64)
        self.flags = np.zeros(1024, np.uint8)  # 1 a number, 2 a unit, 4 capitalised, 8 ends a sentence
        self.numbers, self.units = frozenset(NUMBER_WORDS), frozenset(UNIT_WORDS)

    def _learn(self, words: list[str]) -> None:
        from xxhash import xxh64_intdigest

        used = len(self.index)
        while used + len(words) > len(self.hash):
            self.hash, self.flags = np.concatenate((self.hash, self.hash)), np.concatenate((self.flags, self.flags))
        for at, word in enumerate(words, used):
            bare = word.strip(STRIP)
            low = bare.lower()
            digits = bare[:1].isdigit() or (bare[:1] in "+-$€£" and any(map(str.isdigit, bare)))
            self.hash[at] = xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 7)
            self.flags[at] = (digits or low in self.numbers) | 2 * (low in self.units) | 4 * (bare[:1].isupper() and bare[1:].islower() and bare.isalpha()) | 8 * word.endswith(ENDS)
            self.index[word] = at

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, how many, template hashes of all, kinds of all, hashes of the words themselves)."""
        split = [t.split() for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.index = {}
        new = set()
        for ws in split:
            new.update(ws)
        self._learn([w for w in new if w not in self.index])
        many = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.__getitem__, (w for ws in split for w in ws)), np.int64, int(many.sum()))
        flags, hashes = self.flags[at], self.hash[at]
        first = np.zeros(len(at) + 1, bool)
        first[np.cumsum(many) - many] = True
        before = np.concatenate((np.zeros(1, np.uint8), flags[:-1])) if len(at) else flags
        before[first[:-1]] = 8
        kinds = np.zeros(len(at), np.uint8)
        kinds[(flags & 4 > 0) & (before & 8 == 0)] = NAME
        kinds[(flags & 2 > 0) & (before & 1 > 0)] = UNIT
        kinds[flags & 1 > 0] = NUMBER
        return split, many, np.where(kinds > 0, self.placeholder[kinds], hashes), kinds, hashes


def window_hashes(hashes: np.ndarray, kinds: np.ndarray, plain: np.ndarray, many: np.ndarray, width: int) -> np.ndarray:
    """A hash of the window of ``width`` words that begins at each word, of its template or, where too few words are
    literal, of the words; 0 where no window begins."""
    out = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - width + 1
    if n <= 0:
        return out
    literal = np.concatenate((np.zeros(1, np.int64), np.cumsum(kinds == PLAIN)))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(many) - many, many)
    fits = (np.repeat(many, many) - place)[:n] >= width
    few = np.flatnonzero(fits & (literal[width:] - literal[:-width] < MIN_LITERALS))
    acc, own = np.zeros(n, np.uint64), np.full(len(few), width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            acc = acc * STEP + hashes[i : i + n]
            own = own * STEP + plain[few + i]
        acc[few] = own * STEP
        acc = (acc ^ (acc >> np.uint64(31))) * STEP
        acc = (acc ^ (acc >> np.uint64(29))) | np.uint64(1)
    out[:n] = np.where(fits, acc, 0)
    return out


def _surfaces(words: list[str]) -> list[str]:
    return [w.strip(STRIP).lower() for w in words]


def _slots(kinds: np.ndarray) -> list[int]:
    """Where the placeholders of a window are; none where the hash is that of the words."""
    at = np.flatnonzero(kinds).tolist()
    return at if len(kinds) - len(at) >= MIN_LITERALS else []


def benchmark_templates(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (template: a hash of the template and the pattern of equal slots, item_id: the lowest, n_items, text: of that item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        templates = Templates()
        for batch in batches:
            keys: list[bytes | None] = []
            for text in batch.column(1).to_pylist():
                (words,), _, hashes, kinds, _ = templates.words([text])
                slots = [s for s, k in zip(_surfaces(words), kinds, strict=True) if k]
                key = xxh3_128_digest(hashes.tobytes() + np.array([slots.index(s) for s in slots], np.int64).tobytes())
                keys.append(key if len(words) >= MIN_LITERALS else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *batch.columns], ["template", "id", "text"])

    rows = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).filter("text IS NOT NULL")
    keyed = rows.mapInArrow(run, "template binary, id long, text string").filter("template IS NOT NULL")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text"))
    return keyed.groupBy("template").agg(first.alias("first"), F.count(F.lit(1)).alias("n_items")).select("template", F.col("first.id").alias("item_id"), "n_items", F.col("first.text").alias("text"))


SLOT = "array<struct<at:int,kind:int,surface:string>>"


def benchmark_windows(templates: DataFrame) -> DataFrame:
    """Rows (hash, width, template, item_id, n_items, words, q: the place of the window in the item, slots: the
    placeholders in it) of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Templates()
        for batch in batches:
            out: list[tuple] = []
            for template, item_id, n_items, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (words,), many, hashes, kinds, plain = reader.words([text])
                surfaces, width = _surfaces(words), min(WINDOW, len(words))
                own = window_hashes(hashes, kinds, plain, many, width).view(np.int64)
                for q in np.flatnonzero(own).tolist():
                    slots = [{"at": i, "kind": int(kinds[q + i]), "surface": surfaces[q + i]} for i in _slots(kinds[q : q + width])]
                    out.append((int(own[q]), width, template, item_id, n_items, len(words), q, slots))
            types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("surface", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], x) for n, x in enumerate(types)], ["hash", "width", "template", "item_id", "n_items", "words", "q", "slots"])

    return templates.select("template", "item_id", "n_items", "text").mapInArrow(run, f"hash long, width int, template binary, item_id long, n_items long, words int, q int, slots {SLOT}")


def bit_map(windows: DataFrame) -> np.ndarray:
    """A bit for the leading ``MAP_BITS`` bits of every hash. Executors fill parts of 4096 bits each."""
    chunk = F.shiftrightunsigned("hash", 64 - MAP_BITS + 12)
    bit = F.shiftrightunsigned("hash", 64 - MAP_BITS).bitwiseAND(F.lit(4095))
    set_ = windows.select(chunk.alias("chunk"), F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    words = set_.groupBy("chunk", "word").agg(F.bit_or("bit").alias("bits"))
    packed = words.groupBy("chunk").agg(F.collect_list(F.struct("word", "bits")).alias("words"))  # 64 words a chunk at most
    for row in packed.collect():  # 2 ** (MAP_BITS - 12) rows at most
        for w in row.words:
            out[(row.chunk << 6) + w.word] = np.uint64(w.bits % (1 << 64))
    return out


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - 5 - len(bits).bit_length())
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def document_windows(docs: DataFrame, bits: np.ndarray, widths: list[int], id_column: str, text_column: str) -> DataFrame:
    """Rows (doc, id, hash, width, p: the first word, values: what stands in its placeholders, copies: equal rows) of the
    windows that may be the benchmark's."""
    sent, key = docs.sparkSession.sparkContext.broadcast(bits), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, templates = only(("benchmark", key), lambda: (sent.value, Templates()))
        for batch in batches:
            text = pc.fill_null(batch.column(2), "")
            for i, j in slices(text, SLICE_BYTES):
                split, many, hashes, kinds, plain = templates.words(text.slice(i, j - i).to_pylist())
                starts = np.cumsum(many) - many
                of, out = [], []
                for width in widths:
                    own = window_hashes(hashes, kinds, plain, many, width)
                    at = np.flatnonzero(_in_map(known, own) & (own > 0))
                    for p, row in zip(at.tolist(), (np.searchsorted(starts + many, at, "right")).tolist(), strict=True):
                        first = p - int(starts[row])
                        values = [split[row][first + k].strip(STRIP).lower() for k in _slots(kinds[p : p + width])]
                        of.append(i + row)
                        out.append((int(own[p].view(np.int64)), width, first, values))
                columns = [pa.array([r[n] for r in out], x) for n, x in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())))]
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], ["doc", "id", "hash", "width", "p", "values"])

    rows = docs.select(row_key(id_column, text_column).alias("doc"), F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc long, id long, hash long, width int, p int, values array<string>")
    return found.groupBy("doc", "id", "hash", "width", "p", "values").agg(F.count(F.lit(1)).alias("copies"))


Hit = tuple[int, int, int, list[tuple[int, tuple[int, str], str]]]  # p, q, width, (place in the window, slot, value) ...


def _occurrences(group: list[Hit]) -> list[list[Hit]]:
    """Hits that may be one occurrence of the item: all of the group, those on each diagonal, and runs of diagonals in
    which both places go on, as where words are put in or left out. Where the item begins again a run ends."""
    diagonals = defaultdict(list)
    for hit in group:
        diagonals[hit[0] - hit[1]].append(hit)
    if len(diagonals) == 1:
        return [group]
    runs: list[list[Hit]] = []
    for hits in sorted(diagonals.values()):
        if runs and hits[0][0] > runs[-1][-1][0] and hits[0][1] > runs[-1][-1][1]:
            runs[-1] += hits
        else:
            runs.append(list(hits))
    return [group, *runs, *diagonals.values()]


def _judged(size: int, group: list[Hit]) -> tuple[float, int, int] | None:
    """(coverage, first word, exchanged slots) of an item of ``size`` words by hits, if most agree on what stands in the slots."""
    votes: dict[tuple[int, str], Counter] = defaultdict(Counter)
    for *_, slots in group:
        for _, slot, value in slots:
            votes[slot][value] += 1
    chosen: dict[tuple[int, str], str] = {}
    taken: set[tuple[int, str]] = set()
    for slot, values in sorted(votes.items(), key=lambda x: (-x[1].most_common(1)[0][1], x[0])):
        for value, _ in sorted(values.items(), key=lambda x: (-x[1], x[0])):
            if (slot[0], value) not in taken:
                chosen[slot] = value
                taken.add((slot[0], value))
                break
    aligned = {(p + i, q + i): (slot, value) for p, q, _, slots in group for i, slot, value in slots}
    if sum(chosen.get(slot) == value for slot, value in aligned.values()) < MIN_CONSISTENT * len(aligned):
        return None
    covered = np.zeros(size, bool)
    first = None
    for p, q, width, slots in group:
        if all(chosen.get(slot) == value for _, slot, value in slots):
            covered[q : q + width] = True
            first = p if first is None else first
    return float(covered.mean()), -1 if first is None else first, sum(slot[1] != value for slot, value in chosen.items())


def match(size: int, hits: list[Hit]) -> tuple[float, int, int] | None:
    """(coverage, first word, exchanged slots) of an item of ``size`` words in a document, or None. Hits further apart
    than twice its length are told apart; of what is closer, every occurrence is judged by itself."""
    hits = sorted(hits)
    best, start = None, 0
    for i in range(1, len(hits) + 1):
        if i == len(hits) or hits[i][0] - hits[i - 1][0] > 2 * size:
            for part in _occurrences(hits[start:i]):
                row = _judged(size, part)
                best = row if row and (best is None or row[0] > best[0]) else best
            start = i
    return best if best and best[0] >= MIN_COVERAGE else None


SCHEMA = "doc long, id long, item_id long, n_items long, coverage double, first_word long, n_exchanged long, copies long"


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` of the hits that come sorted by document and template."""

    def judged(rows: list[dict]) -> tuple | None:
        one = rows[0]
        found = match(one["words"], [(r["p"], r["q"], r["width"], [(s["at"], (s["kind"], s["surface"]), v) for s, v in zip(r["slots"], r["values"], strict=True)]) for r in rows])
        return None if found is None else (one["doc"], one["id"], one["item_id"], one["n_items"], *found, one["copies"])

    held: list[dict] = []
    kinds = [pa.float64() if n == 4 else pa.int64() for n in range(8)]
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and (held[0]["doc"], held[0]["template"]) != (row["doc"], row["template"]):
                out.append(judged(held))
                held = []
            held.append(row)
        yield table([r for r in out if r])
    yield table([r for r in [judged(held)] if r] if held else [])


def _found(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_id: str, item_text: str) -> DataFrame:
    """Rows of ``SCHEMA``, one for each different document and item found in it."""
    spark = docs.sparkSession
    expose_package(spark)
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.write(benchmark_windows(benchmark_templates(benchmark, item_id, item_text)))
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # WINDOW at most
    if not widths:
        return spark.createDataFrame([], SCHEMA)
    own = scratch.write(document_windows(docs, bit_map(windows), widths, id_column, text_column))
    items = F.broadcast(windows) if windows.count() <= BROADCAST_ROWS else windows
    hits = own.join(items, ["hash", "width"]).repartition("doc", "template").sortWithinPartitions("doc", "template")
    columns = ["doc", "template", "id", "item_id", "n_items", "words", "p", "q", "width", "slots", "values", "copies"]
    return hits.select(*columns).mapInArrow(judge, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and benchmark item found in it: id, item_id, n_items, coverage, first_word, n_exchanged."""
    found = _found(docs, benchmark, id_column, text_column, item_id, item_text)
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("id").alias(id_column), "item_id", "n_items", "coverage", "first_word", "n_exchanged")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no item of the benchmark contaminates, with their own columns."""
    key = unused(docs, "row_key")
    gone = Scratch(docs.sparkSession, "contaminated").write(_found(docs, benchmark, id_column, text_column, item_id, item_text).select(F.col("doc").alias(key)).distinct())
    return docs.withColumn(key, row_key(id_column, text_column)).join(keys_to_join(gone), key, "left_anti").select(*[F.col(c) for c in docs.columns])
