"""Operator 7: token ids in a grammar-compressed file format.

Texts are encoded in ascending order of their ids and cut into shards of about ``SHARD_IDS`` token ids. A shard is
compressed by Re-Pair: pairs of adjacent symbols are counted exactly, the most frequent become nonterminals and replace
the pair wherever it stands (of overlapping places the left one), and so on until no pair occurs ``LEAST_COUNT`` times. A
round takes the pairs down to a ``STEEP``-th of the highest count. Symbols have 16 bits, and 32 where a shard needs more.

A file is a Parquet table with one row per shard:
  part, shard            order of the shards
  doc_ids, known         64-bit ids, and a byte per document that is 0 where the id is null
  lengths                ids of each document, 64 bits
  alphabet               the ids that occur, 32 bits; symbol n below their number stands for the nth
  rules, rounds          two symbols per nonterminal, in order, 32 bits; nonterminals of each round, 32 bits
  rule_lengths           ids that each nonterminal expands to, 32 bits
  width, symbols         bytes of a symbol, and the symbols of the shard
Expansion lengths allow ``Shard.span`` to decode a range of ids without the rest.

A null text is encoded as empty text and so is the end id alone; texts are encoded whole; a null id sorts first; repeated
ids are ordered by their text; columns other than the id and text are left out, so no name can clash; an empty table
gives an empty file and result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.llm.common import Scratch, broadcast_if_small, expose_package, only, slices

SHARD_IDS = 1 << 20
#: Bytes of text encoded at once, and pieces and their ids that are held.
SLICE_BYTES, CACHE_CHUNKS, CACHE_IDS = 2 << 20, 400_000, 4 << 20
#: New pieces that the library encodes as one text.
TOGETHER = 200
#: Bytes of lower-case text by kind: letters and digits a, full stops and commas p, white space s, the lead byte of
#: accented Latin letters a, other lead bytes x, continuation bytes c, the rest o.
KIND = bytes(
    ord("a" if chr(b).isalnum() and b < 128 or b == 0xC3 else "p" if b in b".," else "s" if b in b" \n" else "o" if b < 128 else "c" if b < 0xC0 else "x") for b in range(256)
)
#: ASCII letters in lower case and line ends as spaces.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256))
MARK, LATIN_END = "\x01", "\u0250"
LEAST_COUNT, STEEP, CELL_BITS = 6, 16, 18
#: Normaliser and pre-tokeniser (kinds and patterns, in order) of the vocabularies that ``Encoder`` can
#: encode piece by piece.
KNOWN_FORM = (
    (("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)),
    (("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)),
)
SCHEMA = "part long, shard long, docs long, ids long, doc_ids binary, known binary, lengths binary, alphabet binary, rules binary, rounds binary, rule_lengths binary, width long, symbols binary"


class Numbering(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


def _kinds(part: dict | None) -> tuple[tuple[str, str | None], ...]:
    """The types and patterns of a tokenizer's component, those of a sequence one by one."""
    if not part:
        return ()
    return tuple((x["type"], (x.get("pattern") or {}).get("Regex")) for x in part.get("normalizers") or part.get("pretokenizers") or [part])


class Encoder:
    """Encodes texts with a vocabulary of the tokenizers library.

    Where its pre-tokens never cross white space, the library sees each piece between ASCII white space once while its
    ids are held; the ids of a text are those of its pieces. Other vocabularies encode whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        form = json.loads(self.tokenizer.to_str())
        self.piecewise = self.size <= 1 << 16 and (_kinds(form["normalizer"]), _kinds(form["pre_tokenizer"])) == KNOWN_FORM and form["model"].get("end_of_word_suffix") == "</w>"
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.ends_word = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends_word[i] = token.endswith("</w>")
        self.between = f" {MARK} "
        if self.piecewise:  # words of lower-case letters need neither normaliser nor patterns
            form |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, form["pre_tokenizer"]["pretokenizers"][-1]]}, "added_tokens": [], "post_processor": None}
            self.bare = Tokenizer.from_str(json.dumps(form))
            (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.end: int | None = None
        self._clear()

    def _clear(self) -> None:
        """Of a number: where its ids begin among all that are held, and how many they are. The end id has number 0."""
        self.numbers, self.ids, self.used = Numbering(), np.zeros(1 << 16, self.kind), 0
        self.start, self.many = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        dict.__setitem__(self.numbers, None, 0)
        if self.end is not None:
            self._hold(np.zeros(1, np.int64), np.array([self.end], self.kind), np.zeros(1, np.int64), np.ones(1, np.int64))

    def _joined(self, tokenizer, text: str) -> np.ndarray:
        (done,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(done.ids, self.kind)

    def _hold(self, numbers: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Takes what ``starts`` and ``ends`` cut out of ``ids`` as the ids of ``numbers``."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.numbers) > len(self.start):
            self.start, self.many = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.many))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[numbers], self.many[numbers] = self.used + starts, ends - starts
        self.used += len(ids)

    def _learn(self) -> None:
        """Encodes many new pieces as one text. A lower-case word ends where an id ends a word; between other pieces
        stands a sign whose id shows where they end."""
        pieces, self.numbers.new = self.numbers.new, []
        first = len(self.numbers) - len(pieces)
        words, others = [], []  # places in ``pieces``
        for place, text in enumerate(pieces):
            if text.isalpha() and (text.isascii() or (text.islower() and max(text) < LATIN_END)):
                words.append(place)
            elif text and MARK not in text:
                others.append(place)
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
                self._hold(np.array([first + place]), ids, np.zeros(1, np.int64), np.array([len(ids)]))
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            ids = self._joined(self.bare, " ".join(map(pieces.__getitem__, part)).lower())
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            self._hold(np.array(part) + first, ids, np.append(0, ends[:-1]), ends)
        for i in range(0, len(others), TOGETHER):
            part = others[i : i + TOGETHER]
            ids = self._joined(self.tokenizer, self.between.join(map(pieces.__getitem__, part)))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            self._hold(np.array(part) + first, ids, np.append(0, ends[:-1] + 1), ends)

    @staticmethod
    def _plain(text: bytes) -> bytes:
        """The text in lower case, with a space before full stops and commas that end a word, so that fewer different
        pieces are left. The library lower-cases and splits there too; not so where it composes signs, takes them for
        special strings first, or where other signs stand before, so such texts stay as they are."""
        if b"\xcc" in text or b"\xcd" in text or b"<|" in text:
            return text
        text = text.translate(LOWER)
        kinds = text.translate(KIND)
        if b"op" in kinds or b"pp" in kinds or b"sp" in kinds or kinds[:1] == b"p":
            return text
        if b"cp" in kinds and (b"x" in kinds or b"\xc3\x97" in text or b"\xc3\xb7" in text):
            return text
        return text.replace(b". ", b" . ").replace(b", ", b" , ")

    def encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each), each text followed by ``end``."""
        if not self.piecewise:
            done = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
            each = [np.array([*x.ids, *([] if end is None else [end])], self.kind) for x in done]
            return np.concatenate(each) if each else np.zeros(0, self.kind), np.fromiter(map(len, each), np.int64, len(each))
        if len(self.numbers) > CACHE_CHUNKS or self.used > CACHE_IDS or end != self.end:
            self.end = end
            self._clear()
        split = pc.ascii_split_whitespace(pa.array([self._plain(t) for t in texts], pa.large_string()))
        last = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        pieces = split.flatten().dictionary_encode()
        known = np.fromiter(map(self.numbers.__getitem__, pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
        if self.numbers.new:
            self._learn()
        at = known[pieces.indices.to_numpy()]
        if end is not None:
            at = np.insert(at, last, 0)
            last = last + np.arange(1, len(last) + 1)
        many = self.many[at]
        total = np.cumsum(many, dtype=np.int64)
        upto = np.concatenate((np.zeros(1, np.int64), total))[np.concatenate((np.zeros(1, np.int64), last))]
        n = int(total[-1]) if len(total) else 0
        small = np.int32 if n + self.used < 1 << 31 else np.int64
        ids = self.ids[np.repeat((self.start[at] - total + many).astype(small), many) + np.arange(n, dtype=small)]
        return ids, np.diff(upto)


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, rules: two symbols each, nonterminals of each round, symbols) of ids."""
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype(np.uint32)
    number = np.zeros(len(present), np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    symbols = number[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    following, rules, rounds = len(alphabet), [], []
    newest = 0  # pairs of older symbols only are known to be rare
    while len(symbols) > 1:
        bits, code, odd = (16, np.uint32, 0x9E3779B1) if symbols.dtype == np.uint16 else (32, np.uint64, 0x9E3779B97F4A7C15)
        pair = (symbols[:-1].astype(code) << code(bits)) | symbols[1:]
        if newest:
            new = symbols >= newest
            ordered = np.sort(pair[new[:-1] | new[1:]])
        else:
            ordered = np.sort(pair)
        if not len(ordered):
            newest = 0
            continue
        start = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(start, append=len(ordered))
        most = int(counts.max())
        if most < LEAST_COUNT and newest:
            newest = 0  # all pairs are counted once more
            continue
        if most < LEAST_COUNT:
            break
        best = np.flatnonzero(counts >= max(LEAST_COUNT, most // STEEP))
        codes = ordered[start[best]]
        # Chosen pairs are found by a table of cells; of those that share one the most frequent comes first, others later.
        cells = lambda x, code=code, odd=odd, bits=bits: (x * code(odd)) >> code(2 * bits - CELL_BITS)
        order = np.argsort(counts[best], kind="stable")
        rule_of, holder = np.full(1 << CELL_BITS, -1, np.int32), np.zeros(1 << CELL_BITS, code)
        rule_of[cells(codes[order])] = order
        every = most // STEEP <= LEAST_COUNT and (rule_of >= 0).sum() == len(codes)
        holder[cells(codes[order])] = codes[order]
        first, second = np.zeros(following, bool), np.zeros(following, bool)
        first[(codes >> code(bits)).astype(np.int64)] = True
        second[(codes & code((1 << bits) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(first[symbols[:-1]] & second[symbols[1:]])
        mine = pair[at]
        cell = cells(mine)
        hit = np.flatnonzero(holder[cell] == mine)
        at, rule = at[hit], rule_of[cell[hit]]
        if (rule < 0).any():  # pair 0, which empty cells hold as well
            at, rule = at[rule >= 0], rule[rule >= 0]
        near = np.diff(at) == 1
        after, before = np.append(False, near), np.append(near, False)
        tied = np.flatnonzero(after | before)
        place = np.arange(len(tied))
        begun = np.maximum.accumulate(np.where(after[tied], 0, place))
        left = np.ones(len(at), bool)
        left[tied] = (place - begun) % 2 == 0
        at, rule = at[left], rule[left]
        kept = np.bincount(rule, minlength=len(codes)) >= LEAST_COUNT // 2  # what overlaps left over is no rule
        if not kept.any():
            break
        newest = following if every else 0
        new = np.where(kept, following - 1 + np.cumsum(kept), 0)
        at, rule = at[kept[rule]], rule[kept[rule]]
        following += int(kept.sum())
        symbols = symbols.astype(np.uint32 if following > 1 << 16 else symbols.dtype)
        symbols[at] = new[rule]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        rules.append(np.stack((codes[kept] >> code(bits), codes[kept] & code((1 << bits) - 1)), axis=1).astype(np.uint32))
        rounds.append(int(kept.sum()))
    return alphabet, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.array(rounds, np.uint32), symbols


def rule_lengths(terminals: int, rules: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """How many ids each nonterminal expands to."""
    size, done = np.ones(terminals + len(rules), np.uint32), 0
    for n in rounds.tolist():
        size[terminals + done : terminals + done + n] = size[rules[done : done + n]].sum(axis=1)
        done += n
    return size[terminals:]


class Shard:
    """A compressed shard and its decoder."""

    def __init__(self, alphabet: np.ndarray, rules: np.ndarray, rounds: np.ndarray, symbols: np.ndarray):
        self.symbols, self.terminals = symbols, len(alphabet)
        self.flat = alphabet  # what every symbol expands to, one after the other
        self.size = np.ones(len(alphabet), np.int64)
        self.start = np.arange(len(alphabet), dtype=np.int64)
        done = 0
        for n in rounds.astype(np.int64):
            part = rules[done : done + n].astype(np.int64).ravel()
            flat, size = self._expand(part), self.size[part].reshape(-1, 2).sum(axis=1)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))
            done += n

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        total = int(size.sum())
        small = np.int32 if total + len(self.flat) < 1 << 31 else np.int64
        return self.flat[np.repeat((self.start[symbols] - np.cumsum(size) + size).astype(small), size) + np.arange(total, dtype=small)]

    def ids(self) -> np.ndarray:
        """All ids."""
        return self._expand(self.symbols)

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``; only the symbols that hold them are expanded."""
        ends = np.cumsum(self.size[self.symbols])
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, max(stop, start + 1), "left")
        before = int(ends[i - 1]) if i else 0
        return self._expand(self.symbols[i : j + 1])[start - before : max(stop - before, start - before)]


def _row(part: int, shard: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    alphabet, rules, rounds, symbols = compress(ids)
    expanded = rule_lengths(len(alphabet), rules, rounds)
    blobs = [
        np.array([d or 0 for d in doc_ids], np.int64), np.array([d is not None for d in doc_ids], np.uint8), lengths.astype(np.int64),
        alphabet, rules, rounds, expanded, symbols.itemsize, symbols,
    ]
    values = [part, shard, len(doc_ids), len(ids), *(b if isinstance(b, int) else b.tobytes() for b in blobs)]
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names)


def open_shard(row: dict) -> tuple[list[int | None], np.ndarray, Shard]:
    """(document ids, ids of each document, decoder) of a row of the file."""
    doc_ids = np.frombuffer(row["doc_ids"], np.int64).tolist()
    known = np.frombuffer(row["known"], np.uint8).tolist()
    words = lambda name: np.frombuffer(row[name], np.uint32)
    symbols = np.frombuffer(row["symbols"], np.uint16 if row["width"] == 2 else np.uint32)
    shard = Shard(words("alphabet"), words("rules").reshape(-1, 2), words("rounds"), symbols)
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], np.frombuffer(row["lengths"], np.int64), shard


def encode_shards(docs: DataFrame, vocabulary: str, end: int | None = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of the file, in ascending order of the ids over (part, shard)."""
    expose_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, shard = only(("encoder", vocabulary), lambda: Encoder(vocabulary)), TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held = [], [], [], 0
        for batch in batches:
            text = pc.fill_null(pc.cast(batch.column(1), pa.binary()), b"")
            for i, j in slices(text, SLICE_BYTES):
                new, many = encoder.encode(text.slice(i, j - i).to_pylist(), end)
                doc_ids += batch.column(0).slice(i, j - i).to_pylist()
                lengths.append(many)
                ids.append(new)
                held += len(new)
                if held >= SHARD_IDS:
                    yield _row(part, shard, doc_ids, np.concatenate(lengths), np.concatenate(ids))
                    doc_ids, lengths, ids, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield _row(part, shard, doc_ids, np.concatenate(lengths), np.concatenate(ids))

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    return dealt.mapInArrow(run, SCHEMA)


def read_shards(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document of a written file: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    expose_package(spark)
    file = spark.read.schema(SCHEMA).parquet(path)
    shards = file.select("part", "shard", "ids")
    parts = shards.groupBy("part").agg(F.sum("ids").alias("in_part"))
    before_part = F.coalesce(F.sum("in_part").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_shard = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before_part", before_part)
    base = shards.withColumn("before_shard", before_shard).join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                doc_ids, lengths, shard = open_shard(row)
                ids = memoryview(shard.ids().astype("<u4")).cast("B")
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]
                n = len(doc_ids)
                columns = [pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["shard"])), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "id", "start", "n_tokens", "ids_crc32"])

    rows = file.mapInArrow(run, "part long, shard long, id long, start long, n_tokens long, ids_crc32 long")
    rows = rows.join(broadcast_if_small(base, shards.count()), ["part", "shard"])
    return rows.select(F.col("id").alias(id_column), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, vocabulary: str, end: int | None = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the file to the shared folder and returns what ``read_shards`` finds in it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repair")
    written = scratch.write(encode_shards(docs, vocabulary, end, id_column, text_column))
    return read_shards(spark, written._scratch_path, id_column)
