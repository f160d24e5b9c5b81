"""Operator 1: exact byte-level BPE token counts by rank-synchronous merging of ragged arrays.

Pre-tokens are held as one flat array of symbols with sequence ends. In every round each sequence finds its
lowest-rank adjacent pair and replaces all its occurrences at once (left to right where they overlap); only the
ranks next to a replacement are looked up again. What is left of a sequence when no pair has a rank is its count.
A merge can only use symbols that earlier merges made, so merging all occurrences of the lowest pair together
gives the same result as merging one at a time.

Nulls count as empty text; repeated rows give repeated rows; an empty table gives an empty result; other columns
of the input play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import only, slices

#: The published pre-tokenisation of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space. A token never continues from a non-space into a space, so texts can be cut there.
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+$")
NONE = np.iinfo(np.int32).max
#: Entries kept per worker before a cache starts anew, the longest key kept, and bytes of text handled at a time.
CACHE_ENTRIES, CACHE_KEY, SLICE_BYTES = 400_000, 64, 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    others take the code points from 256 on in their order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeCounter:
    """Counts tokens under a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.zeros(256, np.int32)
        for char, byte in byte_alphabet().items():
            self.of_byte[byte] = vocab[char]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NONE)

    def merge_counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that are left of each sequence."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        counts = lengths.copy()
        alive = np.flatnonzero(lengths > 1)  # the sequences still in the arrays
        symbols = self.of_byte[np.frombuffer(b"".join(s for s in sequences if len(s) > 1), np.uint8)]
        size = lengths[alive]
        ranks = np.full(len(symbols), NONE, np.int32)  # of the pair that starts here; none at a sequence's end
        if len(symbols):
            ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
        while len(alive):
            ends = np.cumsum(size)
            ranks[ends - 1] = NONE
            lowest = np.minimum.reduceat(ranks, ends - size)
            going = lowest < NONE
            counts[alive] = size
            if not going.all():
                held = np.repeat(going, size)
                alive, size, lowest, symbols, ranks = alive[going], size[going], lowest[going], symbols[held], ranks[held]
                if not len(alive):
                    break
            hit = ranks == np.repeat(lowest, size)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (near := np.diff(at) == 1).any():  # x x x: take every other of a run
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.concatenate(([True], ~near)), place, 0))
                at = at[(place - first) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(size)), size)[at]
            moved = at - np.arange(len(at))  # where the new symbols stand afterwards
            symbols, ranks = symbols[keep], ranks[keep]
            size = size - np.bincount(owner, minlength=len(size))
            starts = np.zeros(len(symbols) + 1, bool)
            starts[np.cumsum(size)] = True
            changed = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            ranks[changed] = NONE
            inner = changed[~starts[changed + 1]]
            ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        return counts

    def _learn(self, missing: list[str], chunks: dict[str, int], words: dict[str, int]) -> None:
        split = [self.pretokens(c) for c in missing]
        new = list({w for ws in split for w in ws if w not in words})
        words.update(zip(new, self.merge_counts([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))
        for c, ws in zip(missing, split, strict=True):
            chunks[c] = sum(map(words.__getitem__, ws))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings counted as one token each."""
        parts, extra = [], []
        for text in texts:
            if self.special_re and any(s in text for s in self.special):
                pieces = self.special_re.split(text)
                extra.append(len(pieces) - 1)
                parts.append([c for p in pieces for c in CHUNK.findall(p)])
            else:
                extra.append(0)
                parts.append(CHUNK.findall(text))
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        chunks = self.chunks
        missing = set()
        for p in parts:
            missing.update(p)
        missing = [c for c in missing if c not in chunks]
        self._learn(missing, chunks, self.words)
        out = [n + sum(map(chunks.__getitem__, p)) for n, p in zip(extra, parts, strict=True)]
        for held in (chunks, self.words):
            for key in [k for k in missing if len(k) > CACHE_KEY]:
                held.pop(key, None)
        return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit. ``vocabulary`` is a path that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = only(("bpe", vocabulary), lambda: BpeCounter(vocabulary))
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            counts: list[int] = []
            for i, j in slices(text, SLICE_BYTES):
                counts += counter.count(text.slice(i, j - i).to_pylist())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
