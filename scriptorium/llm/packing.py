"""Operator 6: pack documents into sequences by cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import cut, table
from .token_counts import VOCABULARY, Encoder

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 1024, 0
#: The linear program stops at this relative gap to its lower bound, or after so many columns.
GAP, COLUMNS = 0.002, 2500
#: Lengths count in the linear program in classes of so many tokens, rounded up.
WIDTH = 4
#: Rows of one length that are ranked together, on average.
RANKED = 5_000


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: whole sequences of a document, and what is left at its end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in common.slices(batches):
            row, rest = [], []
            for i, ids in enumerate(encoder.ids([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    row.append(i)
                    rest.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = np.array(rest, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *map(pa.array, columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {PIECE}")


def best_pattern(lengths: np.ndarray, worth: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: how often each length should be taken into one sequence for the largest worth."""
    best, choice = np.zeros(length + 1), np.full(length + 1, -1)
    fits = np.searchsorted(lengths, np.arange(length + 1), "right")
    for c in range(1, length + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - lengths[:k]] + worth[:k]
            j = value.argmax()
            if value[j] > best[c] + 1e-12:
                best[c], choice[c] = value[j], j
    counts, c = np.zeros(len(lengths), np.int64), length
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= lengths[choice[c]]
    return best[length], counts


def solve(lengths: np.ndarray, demand: np.ndarray, length: int, gap: float = GAP, columns: int = COLUMNS) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used (fractions) in a solution of the linear program.

    Column generation by the revised simplex method: the knapsack prices columns, the smallest ratio leaves the basis.
    It begins with pairs of lengths that fill a sequence, and lengths by themselves.
    """
    m = len(lengths)
    alone = (length // lengths).astype(float)
    patterns, inverse = np.diag(alone), np.diag(1 / alone)
    use = demand / alone
    where = {int(v): i for i, v in enumerate(lengths)}
    for i, v in enumerate(lengths):
        j = where.get(length - int(v))
        if j is not None and i < j:
            few, many = (i, j) if demand[i] <= demand[j] else (j, i)
            patterns[:, few] = 0
            patterns[[i, j], few] = 1
            use[few] = demand[few]
            use[many] = (demand[many] - demand[few]) / alone[many]
            inverse[few, few] = 1
            inverse[many, few] = -1 / alone[many]
    for _ in range(columns):
        worth = inverse.sum(axis=0)
        value, pattern = best_pattern(lengths, np.maximum(worth, 0), length)
        if value <= 1 + gap:  # the bound: the sum of use / value
            break
        step = (inverse * pattern).sum(axis=1)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = ratio.argmin()
        if not np.isfinite(ratio[out]):
            break
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        patterns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return [(patterns[:, k].astype(np.int64), float(use[k])) for k in range(m)]


def plan(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end of ranks, how many in a sequence, first sequence, place).

    Solutions are rounded down; what is left over, less than one sequence for each pattern, goes best-fit decreasing.
    The plan's size depends on the number of lengths (at most `length`), not on the number of documents.
    """
    slots: list[tuple[dict[int, int], int]] = []
    lengths = np.array(sorted(v for v in histogram if v < length), np.int64)
    demand = np.array([histogram[int(v)] for v in lengths], np.int64)
    if histogram.get(length):
        slots.append(({length: 1}, histogram[length]))
    left = demand.copy()
    if len(lengths):
        for pattern, use in solve(lengths, demand.astype(float), length):
            times = min([int(use + 1e-6), *(left[k] // pattern[k] for k in np.flatnonzero(pattern))])
            if times > 0 and pattern.any():
                slots.append(({int(lengths[k]): int(pattern[k]) for k in np.flatnonzero(pattern)}, int(times)))
                left -= times * pattern
    free, bins = np.zeros(0, np.int64), []
    for k in range(len(lengths) - 1, -1, -1):
        v = int(lengths[k])
        for _ in range(int(left[k])):
            room = np.where(free >= v, free, length + 1)
            b = int(room.argmin()) if len(room) else -1
            if b < 0 or room[b] > length:
                bins.append({})
                free, b = np.append(free, length), len(bins) - 1
            bins[b][v] = bins[b].get(v, 0) + 1
            free[b] -= v
    slots += [(x, 1) for x in bins]
    rows, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in slots:
        for place, (v, many) in enumerate(sorted(pattern.items(), reverse=True)):
            rows.append((v, rank[v], rank[v] + times * many, many, sequence, place))
            rank[v] += times * many
        sequence += times
    return rows


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each document.

    A document's ids are those of the library (no special tokens added; null text: none), then END. Whole sequences are
    cut off from the front; the rest stays in one piece. The histogram of lengths in classes of `width` (at most 256
    numbers) goes to the driver, which solves the cutting-stock problem; pieces of a class are ranked by a salted count
    (hash of doc_id), so that a length with a third of all rows is no single task, and take the plan's slots in the order
    of their ranks. The plan is joined by broadcast: its size is bounded by the number of classes. Offsets add up within a
    sequence, in tokens. Repeated rows are packed each; a null doc_id is kept; an empty table gives no rows. Only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    pieces = cut(cut_documents(docs, path or public_tokenizers.path(VOCABULARY), length).withColumn("class", F.ceil(F.col("length") / width)))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, length // width), "class long, rank_begin long, rank_end long, many long, first_sequence long, place long")
    salts = max(16, sum(histogram.values()) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = salted.join(counts, ["class", "salt"]).withColumn("rank", F.col("ahead") + F.row_number().over(within) - 1)
    slot = F.col("rank") - F.col("rank_begin")
    before = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.join(F.broadcast(slots), "class")
        .where((F.col("rank") >= F.col("rank_begin")) & (F.col("rank") < F.col("rank_end")))
        .withColumn("sequence_id", (F.col("first_sequence") + F.floor(slot / F.col("many"))).cast("long"))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
