"""Operator 3: token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table
from .pretoken import SPECIAL, Pretokens

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens that a Python worker remembers; beyond it, it starts afresh.
REMEMBERED = 500_000
#: Bytes and ids of the pre-tokens that it remembers, for each of them.
LETTERS = 16
NONE = np.int32(1 << 30)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary's merges: pair of symbols -> rank, and the symbol that each rank makes. Symbols below 256 are bytes."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        symbols = {text: b for text, b in byte_symbols().items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.empty(len(pairs), np.int64)
        made = np.empty(len(pairs), np.int64)
        for rank, (a, b) in enumerate(pairs):
            keys[rank] = symbols[a] << 32 | symbols[b]
            made[rank] = symbols.setdefault(a + b, 256 + rank)
        self.made = np.append(made, 0)
        self.id_of = np.zeros(256 + len(pairs), np.uint32)
        for text, symbol in symbols.items():
            self.id_of[symbol] = model["vocab"].get(text, 0)
        self.levels = []  # hash tables of keys and ranks; what finds its slot taken goes on to the next, smaller one
        left, bits = np.arange(len(keys)), 20
        while len(left):
            slot = self.slot(keys[left], bits)
            _, first = np.unique(slot, return_index=True)
            table, rank = np.full(1 << bits, -1), np.full(1 << bits, NONE, np.int32)
            table[slot[first]], rank[slot[first]] = keys[left[first]], left[first]
            self.levels.append((bits, table, rank))
            left, bits = np.delete(left, first), max(12, bits - 4)

    @staticmethod
    def slot(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + (bits << 9))) >> np.uint64(64 - bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge."""
        key = left << 32 | right
        out = np.full(len(key), NONE, np.int32)
        for bits, table, rank in self.levels:
            at = self.slot(key, bits)
            hit = table[at] == key
            out[hit] = rank[at[hit]]
        return out

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of each sequence, which lie one after the other in `symbols`, and how many they are.

        In each round, every sequence finds its lowest rank among neighbouring pairs and merges that pair wherever it
        stands (from the left where occurrences overlap); sequences without a pair to merge leave the arrays.
        """
        symbols, sizes, alive = symbols.astype(np.int64), sizes.astype(np.int64), np.arange(len(sizes))
        count, done, owners = sizes.copy(), [], []
        while len(alive):
            first = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), NONE)
            rank[:-1] = self.find(symbols[:-1], symbols[1:])
            rank[first + sizes - 1] = NONE  # no pair across sequences
            low = np.minimum.reduceat(rank, first)
            goes_on = low < NONE
            if not goes_on.all():
                keep = np.repeat(goes_on, sizes)
                done.append(symbols[~keep])
                owners.append(alive[~goes_on])
                count[alive[~goes_on]] = sizes[~goes_on]
                symbols, rank, alive, sizes, low = symbols[keep], rank[keep], alive[goes_on], sizes[goes_on], low[goes_on]
                if not len(alive):
                    break
            hit = rank == np.repeat(low, sizes)
            if (hit[1:] & hit[:-1]).any():  # runs like "aaaa": every other one, from the left
                where = np.flatnonzero(hit)
                new = np.diff(where, prepend=-2) != 1
                place = where - where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
                hit[where[place % 2 == 1]] = False
            symbols[hit] = self.made[rank[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[1:] = hit[:-1]
            sizes = sizes - np.add.reduceat(gone, np.cumsum(sizes) - sizes, dtype=np.int64)
            symbols = symbols[~gone]
        # what left the arrays in different rounds, back in order
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        begin = np.empty(len(count), np.int64)
        begin[owner] = np.cumsum(count[owner]) - count[owner]
        flat = np.concatenate([np.zeros(0, np.int64), *done])
        return flat[np.repeat(begin, count) + common.ragged(count)], count

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        return self.id_of[symbols]


class Encoder:
    """Token ids, or their counts, of texts; remembers those of pre-tokens. Hashes find them, their bytes decide."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = next(x["id"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"] if x["content"] == SPECIAL)
        self.forget()

    def forget(self) -> None:
        """known: hashes, in order; slot: their entries. An entry's ids are in `ids_pool` between ids_at[k] and ids_at[k + 1], its bytes in `text`."""
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids_at, self.text_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids_pool, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def add(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """New entries for these pre-tokens: their numbers."""
        text = data[np.repeat(start, length) + common.ragged(length)]
        symbols, size = self.merges.merge(text, length)
        new = len(self.ids_at) - 1 + np.arange(len(size))
        self.ids_at = np.concatenate((self.ids_at, len(self.ids_pool) + np.cumsum(size)))
        self.text_at = np.concatenate((self.text_at, len(self.text) + np.cumsum(length)))
        self.ids_pool, self.text = np.concatenate((self.ids_pool, self.merges.ids(symbols))), np.concatenate((self.text, text))
        return new

    def learn(self, p: Pretokens) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each pre-token are in the pool, and how many they are."""
        seen, first, back = np.unique(p.hash, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED or max(len(self.text), len(self.ids_pool)) > LETTERS * REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, seen)
        new = np.append(self.known, seen[-1:])[place] != seen
        new |= place == len(self.known)
        length = p.end - p.start
        if new.any():
            own = self.add(p.bytes, p.start[first[new]], length[first[new]])
            self.known, self.slot = np.insert(self.known, place[new], seen[new]), np.insert(self.slot, place[new], own)
            place += np.cumsum(new) - new
        entry = self.slot[place[back]].astype(np.int64)
        begin = self.text_at[entry]
        other = self.text_at[entry + 1] - begin != length
        same = np.flatnonzero(~other)
        many = length[same]
        step = common.ragged(many)
        differs = self.text[np.repeat(begin[same], many) + step] != p.bytes[np.repeat(p.start[same], many) + step]
        if differs.any():
            other[same] = np.logical_or.reduceat(differs, np.cumsum(many) - many)
        if other.any():  # another pre-token has its hash: its ids are made for this once
            entry[other] = self.add(p.bytes, p.start[other], length[other])
        return self.ids_at[entry], self.ids_at[entry + 1] - self.ids_at[entry]

    def split(self, texts: list[str]) -> tuple[Pretokens, list[int]]:
        """Pre-tokens of the texts, of which those with the special token's string are in several pieces; owners of the pieces."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            pieces = t.split(SPECIAL) if SPECIAL in t else [t]
            parts += pieces
            owner += [i] * len(pieces)
        return Pretokens(parts), owner

    def count(self, texts: list[str]) -> np.ndarray:
        p, owner = self.split(texts)
        sums = np.concatenate(([0], np.cumsum(self.learn(p)[1])))
        out = np.full(len(texts), -1, np.int64)  # a special token between two pieces
        np.add.at(out, np.array(owner, np.int64), sums[p.first[1:]] - sums[p.first[:-1]] + 1)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        p, owner = self.split(texts)
        at, size = self.learn(p)
        ids = self.ids_pool[np.repeat(at, size) + common.ragged(size)]
        bounds = np.concatenate(([0], np.cumsum(size)))[p.first]
        out: list[np.ndarray | None] = [None] * len(texts)
        for k, i in enumerate(owner):
            piece = ids[bounds[k] : bounds[k + 1]]
            out[i] = piece if out[i] is None else np.concatenate((out[i], [np.uint32(self.special)], piece))
        return out


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_bytes (UTF-8) and n_tokens of every row's whole text.

    Counts equal those of the library without added special tokens. Null and empty texts: 0 and 0. A narrow map: no
    shuffle; rows are counted in runs of about 1 MB of text, a longer text by itself. Repeated rows each give a row, an
    empty table none. Columns of docs other than `text` and `keep` are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(*keep, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", n_bytes long, n_tokens long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sizes, pa.int64()), pa.array(encoder.count(texts))], [*keep, "n_bytes", "n_tokens"])

    return rows.mapInArrow(work, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
