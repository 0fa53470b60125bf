"""Many words looked for at once: an automaton with failure links, whose steps run for thousands of places of texts together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that each lane goes through (besides those before it that a word may begin in); bytes of texts in one run.
LANE, RUN = 512, 1 << 20


class Automaton:
    """Words as UTF-8. `step`: state and class of a byte -> state; `word`: the word that ends in a state (or -1); `shorter`: the
    next state along failure links in which a word ends (or 0); `ends`: whether any word ends in a state."""

    def __init__(self, words: Sequence[str]):
        coded = [w.encode() for w in words]
        self.longest = max(map(len, coded), default=0)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.group = np.zeros(256, np.int32)  # 0: bytes that are in no word
        used = np.unique(np.frombuffer(b"".join(coded), np.uint8))
        self.group[used] = np.arange(1, len(used) + 1)
        self.many = len(used) + 1
        letters = np.zeros((len(coded), self.longest), np.int32)
        for i, w in enumerate(coded):
            letters[i, : len(w)] = self.group[np.frombuffer(w, np.uint8)]
        at, levels, total = np.zeros(len(coded), np.int64), [], 1
        word: dict[int, int] = {}
        for depth in range(self.longest):  # the trie, a level at a time
            alive = np.flatnonzero(size > depth)
            edges, back = np.unique(at[alive] * self.many + letters[alive, depth], return_inverse=True)
            at[alive] = total + back
            levels.append((total + np.arange(len(edges)), edges // self.many, edges % self.many))
            total += len(edges)
        for i in np.flatnonzero(size > 0):
            word.setdefault(int(at[i]), int(i))
        self.step = np.zeros((total, self.many), np.int32)
        self.word, self.shorter = np.full(total, -1, np.int64), np.zeros(total, np.int64)
        self.word[list(word)] = list(word.values())
        fail = np.zeros(total, np.int64)
        for depth, (nodes, parent, letter) in enumerate(levels):
            # what a state does without children of its own is what its failure does; parents got their rows a level before
            fail[nodes] = 0 if depth == 0 else self.step[fail[parent], letter]
            self.step[parent, letter] = nodes
            self.step[nodes] = self.step[fail[nodes]]
            self.shorter[nodes] = np.where(self.word[fail[nodes]] >= 0, fail[nodes], self.shorter[fail[nodes]])
            if depth == 0:  # failures of the first level point to the root, whose row has just got its children
                self.step[nodes] = self.step[0]
        self.ends = (self.word >= 0) | (self.shorter > 0)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of every occurrence, overlapping ones too.

        Texts lie one after the other with a byte between them that belongs to no word. Lanes of LANE bytes begin at the root
        a word's length earlier: from there on, every word that ends in the lane is met.
        """
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        stop = np.cumsum(sizes)
        data = self.group[np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)]
        data[stop - 1] = 0
        if self.longest == 0 or not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ahead = self.longest - 1
        lanes = -(-len(data) // LANE)
        padded = np.zeros(ahead + lanes * LANE, np.int32)
        padded[ahead : ahead + len(data)] = data
        begin = np.arange(lanes) * LANE
        state, places, states = np.zeros(lanes, np.int32), [], []
        for k in range(ahead + LANE):
            state = self.step[state, padded[begin + k]]
            if k >= ahead and (hit := np.flatnonzero(self.ends[state])).size:
                places.append(begin[hit] + k - ahead)
                states.append(state[hit])
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        state = np.concatenate(states).astype(np.int64) if states else np.zeros(0, np.int64)
        found = []
        while len(state):
            own = self.word[state] >= 0
            found.append((place[own], self.word[state[own]]))
            state, place = self.shorter[state], place[self.shorter[state] > 0]
            state = state[state > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, which = (np.concatenate(x) for x in zip(*found))
        return np.searchsorted(stop, place, "right"), which


@lru_cache(maxsize=4)
def automaton(words: tuple[str, ...]) -> Automaton:
    return Automaton(words)


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > RUN:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def with_words(rows: DataFrame, text: str, words: Sequence[str], name: str = "found") -> DataFrame:
    """rows with `name`: array of (word: its place among the words, times), the words that the text contains.

    Occurrences may overlap, and words may hold each other. Of words given twice the first place counts; an empty word is
    never found. Null and empty texts contain none. All words are looked for in one pass: its time grows with the texts and
    hardly with the words. The words are a parameter: each worker makes their automaton once.
    """
    words = tuple(words)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name) + f", `{name}` array<struct<word:int,times:long>>"
    columns = [c for c in rows.columns if c != name]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = automaton(words)
        for batch in batches:
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            owner, word, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in _runs(texts):
                who, which = look.find(texts[a:b])
                keys, many = np.unique(who * max(1, len(words)) + which, return_counts=True)
                owner.append(a + keys // max(1, len(words)))
                word.append(keys % max(1, len(words)))
                times.append(many)
            counts = np.bincount(np.concatenate(owner), minlength=len(texts)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(np.concatenate(word).astype(np.int32)), pa.array(np.concatenate(times))], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists], [*columns, name])

    return rows.mapInArrow(work, schema)
