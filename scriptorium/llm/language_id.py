"""Operator 10: language identification of mixed text: script ranges, character n-grams, Viterbi over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table

UNKNOWN = "und"
#: First code points of the scripts' ranges (fixed values, a coarse map: each range reaches to the next one).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
#: n-grams of these sizes fall into BUCKETS of a table of log probabilities; LEARNED documents a language are learned from.
SIZES, BUCKETS, LEARNED = (1, 2, 3, 4), 1 << 14, 1000
#: What it costs to change the language between two words, in units of log probability.
SWITCH = 6.0
#: A language uses a script that has at least this share of its letters.
SHARE = 0.02


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = chr(c).isalpha()
    return out


class Text:
    """Words (runs of letters) of a run of texts, n-gram buckets of the different ones, and scripts."""

    letters: np.ndarray | None = None
    names = sorted({name for _, name in SCRIPTS})
    starts = np.array([a for a, _ in SCRIPTS])
    kinds = np.array([sorted({name for _, name in SCRIPTS}).index(name) for _, name in SCRIPTS], np.int8)

    def __init__(self, texts: list[str]):
        if Text.letters is None:
            Text.letters = _letters()
        lower = [t.lower() for t in texts]
        code = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lower]))) + 1
        full = Text.letters[code]
        step = np.diff(full.view(np.int8))
        self.start, self.end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.first = np.searchsorted(self.start, base)
        self.code = code
        # each different word once, with blanks around it: what it scores depends on its own letters alone
        size = self.end - self.start
        name = common.span(common.prefix(common.mix(code.astype(np.uint64) + np.uint64(1))), self.start, self.end)
        long = np.flatnonzero(size > common.SURE)  # not looked for among others
        name[long] = common.mix(np.arange(len(long), dtype=np.uint64))
        _, one, self.word, self.times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        self.size = size[one]
        most = max(SIZES)
        step = common.ragged(self.size)
        self.place = np.repeat(np.cumsum(self.size + most) - self.size - most + 1, self.size) + step
        self.padded = np.full(int((self.size + most).sum()) + most, 0x20, np.uint64)
        self.padded[self.place] = code[np.repeat(self.start[one], self.size) + step]

    def script(self) -> np.ndarray:
        return Text.kinds[np.searchsorted(Text.starts, self.code[self.start], "right") - 1]

    def grams(self, size: int) -> np.ndarray:
        """The bucket of the n-gram at each letter of the different words; but for single letters, it begins one before."""
        value = np.zeros(len(self.place), np.uint64)
        for k in range(size):
            value = value * np.uint64(0x110003) + self.padded[self.place + (k - (size > 1))]
        return (common.mix(value + np.uint64(size)) >> np.uint64(50)).astype(np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Weights (buckets x languages, for each size) added up over each word."""
        out = np.zeros((len(self.size), weights.shape[2]))
        for s, size in enumerate(SIZES):
            if len(out):
                out += np.add.reduceat(weights[s][self.grams(size)], np.cumsum(self.size) - self.size, axis=0)
        return out[self.word]


def learn(docs: DataFrame, most: int = LEARNED) -> dict:
    """Languages, their tables of log probabilities and their scripts, from rows (doc_id, text, lang) with a language.

    Learned from about `most` documents a language (those with a hash of doc_id below a bound); n-gram counts are added up
    by language in the cluster, and only the table (languages x sizes x BUCKETS numbers) reaches the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    share = [x for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect() for x in (F.lit(r["lang"]), F.lit(most / r["n"]))]
    some = known.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(F.create_map(*share), F.col("lang")) * (1 << 20)) if share else known

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == name]
                grams, script = np.zeros((len(SIZES), BUCKETS), np.int64), np.zeros(len(Text.names), np.int64)
                for a, b in common.runs(own, 1 << 19):
                    t = Text(own[a:b])
                    for s, size in enumerate(SIZES):
                        grams[s] += np.bincount(t.grams(size), np.repeat(t.times, t.size), BUCKETS).astype(np.int64)
                    script += np.bincount(t.script(), t.end - t.start, len(Text.names)).astype(np.int64)
                place = np.flatnonzero(grams)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(place) + len(script))), pa.array(np.concatenate((place, -1 - np.arange(len(script))))), pa.array(np.concatenate((grams.ravel()[place], script)))], ["lang", "place", "n"])

    found = some.select("lang", "text").mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    grams, script = np.zeros((len(SIZES) * BUCKETS, len(names))), np.zeros((len(Text.names), len(names)))
    if names:
        row = np.searchsorted(np.array(names), np.array(found.column("lang").to_pylist()))
        place, n = found.column("place").to_numpy(), found.column("n").to_numpy()
        plain = place >= 0
        grams[place[plain], row[plain]] = n[plain]
        script[-1 - place[~plain], row[~plain]] = n[~plain]
    grams = grams.reshape(len(SIZES), BUCKETS, len(names)) + 0.5
    share = script / np.maximum(1, script.sum(axis=0))
    return {"names": names, "weights": np.log(grams / grams.sum(axis=1, keepdims=True)), "uses": share >= SHARE}


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; first: of the texts, and the end.

    All texts advance together, a word at a time, the longest first, so that each step works on a leading slice.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # texts with more than t words
    came = np.empty(score.shape, np.int16)
    best = np.zeros((len(sizes), score.shape[1]))
    own = np.arange(score.shape[1], dtype=np.int16)
    for t in range(steps):
        n = active[t]
        now = best[:n]
        if t:
            top = now.argmax(axis=1)
            other = now[np.arange(n), top] - switch
            stay = now >= other[:, None]
            came[begin[:n] + t] = np.where(stay, own, top[:, None])
            now = np.maximum(now, other[:, None])
        best[:n] = now + score[begin[:n] + t]
    state = np.zeros(len(sizes), np.int64)
    path = np.empty(len(score), np.int64)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        ends = np.arange(active[t + 1] if t + 1 < steps else 0, n)  # texts whose last word this is
        state[ends] = best[ends].argmax(axis=1)
        at = begin[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return path


def label(texts: list[str], model: dict) -> tuple[Text, np.ndarray, np.ndarray]:
    """Words, their scores by language and their labels."""
    t = Text(texts)
    allowed = model["uses"][t.script()]
    allowed |= ~allowed.any(axis=1)[:, None]  # a script that no language uses rules nothing out
    score = np.where(allowed, t.sums(model["weights"]), -1e4)
    return t, score, viterbi(score, t.first)


def identify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score and spans (language, first word, end) of every row's whole text.

    A word's script leaves the languages that use it; the log probabilities of its n-grams add up to its scores; Viterbi
    with a price for switching labels the words. lang_pred has the most letters (ties: the first name), score is its share
    of all letters. Null texts and texts without letters: `und`, 0 and no spans. Rows are independent: no shuffle, repeated
    rows each give a row, and other columns (lang, source) are never read. An empty table gives no rows; a text of any length
    is one row's work.
    """
    rows = docs.select(*keep, F.col("text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, spans = [], [], []
            for a, b in common.runs(texts, (1 << 21) // max(4, len(model["names"]))):
                if not model["names"]:
                    langs += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    spans += [[]] * (b - a)
                    continue
                t, _, path = label(texts[a:b], model)
                size = (t.end - t.start).astype(float)
                row = np.repeat(np.arange(b - a), np.diff(t.first))
                letters = np.bincount(row * len(model["names"]) + path, size, (b - a) * len(model["names"])).reshape(b - a, -1)
                turn = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                ends = np.append(turn[1:], len(path))
                own = [[] for _ in range(b - a)]
                for i, k, s, e in zip(row[turn].tolist(), path[turn].tolist(), (turn - t.first[row[turn]]).tolist(), (ends[: len(turn)] - t.first[row[turn]]).tolist()):
                    own[i].append({"lang": model["names"][k], "first_word": s, "end_word": e})
                for i in range(b - a):
                    total = letters[i].sum()
                    k = int(letters[i].argmax())
                    langs.append(model["names"][k] if total else UNKNOWN)
                    scores.append(float(letters[i][k] / total) if total else 0.0)
                spans += own
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], [*keep, "lang_pred", "score", "spans"])

    return rows.mapInArrow(work, f"{kinds}, lang_pred string, score double, spans array<struct<lang:string,first_word:bigint,end_word:bigint>>")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = learn(docs.where(fold != 0))
    return identify(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
