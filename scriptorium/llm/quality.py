"""Operator 2: document quality by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table

#: The classifiers are fitted on at most so many labelled documents, and exchange labels of so many others.
LABELLED, POOL = 4000, 4000
#: Rounds of exchange; what counts as confident; the share of the pool that each view may label in a round, by class.
ROUNDS, CONFIDENT, EXCHANGED = 4, 0.95, 0.05
#: Documents whose combined probability is below this are rejected.
THRESHOLD = 0.5
#: A view counts if its area under the curve on held-out labels is above one half by so much, and by two standard errors.
MARGIN = 0.1
#: Parts of the labels where too few are held out.
FOLDS = 5
#: Sizes of the views' feature vectors: byte shares, text shape and hashed words; hashed source and language, length class.
SHAPE, WORDS, SOURCES, LANGS, LENGTHS = 12, 256, 64, 16, 14
TEXT, META = 128 + SHAPE + WORDS, SOURCES + LANGS + LENGTHS


def text_view(texts: list[bytes]) -> np.ndarray:
    """Features of texts: shares of bytes, shape (capitals, digits, marks, repetition of words and lines, lengths), shares of words."""
    out = np.zeros((len(texts), TEXT))
    for a, b in common.runs(texts):
        w = common.Words(texts[a:b])
        row_of_word, hashes = w.rows(), w.hash
        order = np.lexsort((hashes, row_of_word))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row_of_word[order][1:] != row_of_word[order][:-1])
        distinct = np.bincount(row_of_word[order][new], minlength=b - a)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        top = np.zeros(b - a)
        np.maximum.at(top, row_of_word[order][new], size)
        words = np.diff(w.first)
        letters = np.bincount(row_of_word, w.end - w.start, b - a)
        bucket = (hashes >> np.uint64(40)).astype(np.int64) % WORDS
        shares = np.bincount(row_of_word * WORDS + bucket, minlength=(b - a) * WORDS).reshape(b - a, WORDS) / np.maximum(1, words)[:, None]
        for i in range(a, b):
            data = w.data[w.base[i - a] : w.base[i - a + 1] - 1]
            n = max(1, len(data))
            count = np.bincount(data, minlength=256)
            lines = texts[i].split(b"\n")
            k = i - a
            shape = [
                count[65:91].sum() / n, count[97:123].sum() / n, count[48:58].sum() / n, count[128:].sum() / n,
                (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / n,
                distinct[k] / max(1, words[k]), top[k] / max(1, words[k]), len(set(lines)) / len(lines), np.log1p(len(lines)),
                np.log1p(words[k]), letters[k] / max(1, words[k]) / 10, float(len(data) == 0),
            ]
            out[i, :128] = np.sqrt(count[:128] / n)
            out[i, 128 : 128 + SHAPE] = shape
        out[a:b, 128 + SHAPE :] = np.sqrt(shares)
    return out


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Features of metadata; null is a value of its own."""
    out, at = np.zeros((len(source), META)), np.arange(len(source))
    for values, first, many in ((source, 0, SOURCES), (lang, SOURCES, LANGS)):
        place = {v: first + zlib.crc32(repr(v).encode()) % many for v in set(values)}
        out[at, np.fromiter((place[v] for v in values), np.int64, len(values))] = 1
    n = np.array([-1 if v is None else v for v in n_chars], float)
    out[at, SOURCES + LANGS + np.minimum(LENGTHS - 1, np.where(n < 0, 0, 1 + (np.log2(1 + np.maximum(n, 0)) / 1.5).astype(int)))] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Logistic regression on standardised features, by accelerated gradient descent with a penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 400):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = np.ones((len(x), x.shape[1] + 1))
        np.divide(np.subtract(x, self.mean, out=z[:, 1:]), self.scale, out=z[:, 1:])  # in place: this runs in the driver
        rate = 1 / (0.25 * max(1.0, np.einsum("ij,ij->", z, z) / len(z) / 4) + penalty)
        w = ahead = np.zeros(z.shape[1])
        for t in range(steps):
            slope = (sigmoid(z @ ahead) - y) @ z / len(z) + penalty * ahead
            new = ahead - rate * slope
            ahead, w = new + (t / (t + 3)) * (new - w), new
        self.weights = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        z /= self.scale
        return self.weights[0] + np.einsum("ij,j->i", z, self.weights[1:])


def area(score: np.ndarray, y: np.ndarray) -> float:
    """The area under the curve: the share of pairs (good, bad) in the right order, ties by half."""
    _, place, many = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[place]
    good, bad = (y == 1).sum(), (y == 0).sum()
    return float((rank[y == 1].sum() - good * (good + 1) / 2) / (good * bad))


class CoTrained:
    """Two calibrated views. Without labels of both classes, everything gets the share of good labels (1 without any).

    Held-out labels calibrate a view before each round, and decide what it may do: a view whose order of them isn't above
    chance by a margin hands over nothing and adds nothing to the score. What a view has been handed is taken back where it
    is itself as sure of the opposite, and all of a round's labels if its loss on the held-out ones has grown with them by
    more than a standard error. Where fewer than five labels of a class are held out, all are learned from, and models
    without a fifth of them judge that fifth.
    """

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, hold: np.ndarray):
        """y: 1, 0, or -1 where there is no label; hold: labelled rows that only calibrate."""
        views, known, held = (text, meta), (y >= 0) & ~hold, hold & (y >= 0)
        self.prior = float(y[y >= 0].mean()) if (y >= 0).any() else 1.0
        self.views, self.exchanged = None, [0, 0]
        enough = min(y[part].sum() if k else (1 - y[part]).sum() for part in (held, known) for k in (0, 1)) >= 5
        if not enough:
            known = held = y >= 0
        if min(y[known].sum(), (1 - y[known]).sum()) < 5:
            return
        good, bad = y[held].sum(), (1 - y[held]).sum()
        least = 0.5 + max(MARGIN, 2 * np.sqrt((good + bad + 1) / (12 * good * bad)))

        def fitted(x: np.ndarray, own: np.ndarray):
            """Model, calibration, whether it counts, and its losses on the held-out labels."""
            model = Logistic(x[own >= 0], own[own >= 0])
            z = model.logit(x[held])
            if not enough:  # labels that are learned from calibrate by models that have not seen them
                fold = np.arange(len(z)) % FOLDS
                for f in range(FOLDS):
                    rest = own >= 0
                    rest[np.flatnonzero(held)[fold == f]] = False
                    z[fold == f] = Logistic(x[rest], own[rest]).logit(x[held][fold == f])
            z = z[:, None]
            calibration = Logistic(z, y[held], 1e-2)
            p = np.clip(sigmoid(calibration.logit(z)), 1e-6, 1 - 1e-6)
            return model, calibration, area(z[:, 0], y[held]) >= least and calibration.weights[1] > 0, -np.log(np.where(y[held] == 1, p, 1 - p))

        labels = [np.where(known, y, -1) for _ in views]  # what each view learns from
        state = [fitted(x, own) for x, own in zip(views, labels)]
        for _ in range(ROUNDS):
            sure_of = [sigmoid(c.logit(m.logit(x)[:, None])) for (m, c, *_), x in zip(state, views)]
            new = [own.copy() for own in labels]
            for mine, p in enumerate(sure_of):
                other, given = new[1 - mine], (y < 0) & (labels[1 - mine] >= 0)
                if state[1 - mine][2]:
                    against = np.where(other == 1, 1 - sure_of[1 - mine], sure_of[1 - mine])
                    other[given & (against >= CONFIDENT)] = -1
                if not state[mine][2]:
                    continue
                for value, sure in ((1, p), (0, 1 - p)):
                    free = np.flatnonzero((y < 0) & (labels[1 - mine] < 0) & (sure >= CONFIDENT))
                    other[free[np.argsort(-sure[free], kind="stable")][: int(EXCHANGED * (y < 0).sum())]] = value
            for k, x in enumerate(views):
                if (new[k] != labels[k]).any():
                    after = fitted(x, new[k])
                    more = after[3] - state[k][3]
                    if more.mean() <= more.std() / np.sqrt(len(more)):
                        labels[k], state[k] = new[k], after
        self.exchanged = [int(((own >= 0) & (y < 0)).sum()) for own in labels]
        self.views, self.calibration, self.counts = [s[0] for s in state], [s[1] for s in state], [s[2] for s in state]
        if not any(self.counts):  # none is above chance: the text decides as far as it can
            self.counts = [True, False]

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, the metadata view, and both: the calibrated logits of views that count add up, the prior counts once."""
        if self.views is None:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        a, b = (c.logit(m.logit(x)[:, None]) for c, m, x in zip(self.calibration, self.views, (text, meta)))
        prior = np.log(self.prior / (1 - self.prior))
        both = sum(z - prior for z, counts in zip((a, b), self.counts) if counts)
        return sigmoid(a), sigmoid(b), sigmoid(both + prior)


COLUMNS = ("text", "source", "lang", "n_chars")


def matrix(rows: pa.ChunkedArray) -> np.ndarray:
    """Feature vectors as a matrix of doubles, chunk by chunk: as lists, each number would be an object of the driver's Python."""
    out, at = np.empty((len(rows), TEXT + META)), 0
    for chunk in rows.chunks:
        out[at : at + len(chunk)] = chunk.flatten().to_numpy().reshape(-1, TEXT + META)
        at += len(chunk)
    return out


def train(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Fit on LABELLED labelled documents and POOL others, those with the smallest hashes of doc_id (documented bounds).

    labels: doc_id, quality (several labels of a document: the smallest counts; null: none). The chosen ids are joined to
    the documents by broadcast (their number is bounded); the features of these rows alone reach the driver.
    """
    h = F.xxhash64("doc_id", F.lit("co-training"))
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).select("doc_id", (F.col("quality") > 0).cast("int").alias("y"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    seeds = marked.join(ids, "doc_id", "left_semi").withColumn("h", h).orderBy("h", "doc_id").limit(LABELLED)
    pool = ids.join(marked, "doc_id", "left_anti").withColumn("h", h).orderBy("h", "doc_id").limit(POOL).withColumn("y", F.lit(-1))
    chosen = seeds.unionByName(pool)
    # of several rows with one doc_id, one (by a hash) stands for all, so that the bounds hold
    own = F.min_by(F.struct("h", "y", *COLUMNS), F.xxhash64(*COLUMNS)).alias("own")
    rows = docs.select("doc_id", *COLUMNS).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(own).select("own.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = np.hstack((text_view(common.utf8(batch.column("text"))), meta_view(*(batch.column(c).to_pylist() for c in COLUMNS[1:])))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["h", "y", "x"])

    found = rows.mapInArrow(features, "h long, y int, x array<float>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y, h = found.column("y").to_numpy(), found.column("h").to_numpy()
    x = matrix(found.column("x"))
    del found
    return CoTrained(x[:, :TEXT], x[:, TEXT:], y, (h % 4 == 0) & (y >= 0))


def classify(docs: DataFrame, model: CoTrained, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, text_score, meta_score and score (calibrated probabilities of good quality) and kept.

    A narrow map over whole texts, in runs of about 1 MB (a longer text by itself); null texts count as empty, null metadata as a value of its own; repeated rows each give
    a row, an empty table none; other columns are not read.
    """
    rows = docs.select(*dict.fromkeys((*keep, *COLUMNS)))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts, (source, lang, n_chars) = common.utf8(batch.column("text")), (batch.column(c).to_pylist() for c in COLUMNS[1:])
            scores = model.probabilities(text_view(texts), meta_view(source, lang, n_chars))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, scores), pa.array(scores[2] >= THRESHOLD)], [*keep, "text_score", "meta_score", "score", "kept"])

    return rows.mapInArrow(work, f"{kinds}, text_score double, meta_score double, score double, kept boolean")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
