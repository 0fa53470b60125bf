"""Operator 4: repeated passages of words, found by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import cut, table

#: Words of a passage; words of a reference block. A passage holds at least RUN whole blocks of any alignment.
PASSAGE, BLOCK = 50, 5
RUN = (PASSAGE - BLOCK + 1) // BLOCK
#: Occurrences of an anchor above which the passages with it are split into several groups.
SPLIT = 2_000
#: Makes other values of the words' hashes, for the second half of a passage's hash.
OTHER = np.uint64(0xA0761D6478BD642F)
#: What is in a passage's tag: where it begins, how many documents have one of its windows, whether it has a hit.
PLACE, N, LATER = "cast(shiftright(tag, 32) as int)", "cast(shiftright(tag, 1) & 2147483647 as int)", "tag & 1 = 1"


def chosen(w: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word where RUN blocks of one text can begin: the place of their anchor; all block hashes; that it is so.

    Every rolling window of BLOCK words is hashed. Of each RUN windows at steps of BLOCK, the one with the smallest hash
    (the first of equals) is an anchor. The choice depends on the words of a passage alone, whichever text it stands in:
    the same rule picks the reference blocks that are indexed and, at any alignment, the windows that probe the index.
    """
    hashes = common.rolling(common.prefix(w.hash), BLOCK)
    n = max(0, len(hashes) - BLOCK * (RUN - 1))
    best, place = hashes[:n].copy(), np.arange(n)
    for k in range(1, RUN):
        here = hashes[k * BLOCK : k * BLOCK + n]
        less = here < best
        best[less] = here[less]
        place[less] = np.flatnonzero(less) + k * BLOCK
    stop = w.first[np.minimum(np.searchsorted(w.first, np.arange(n), "right"), len(w.first) - 1)]
    return place, hashes, np.arange(n) + BLOCK * RUN <= stop


def anchors(w: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (first words) and hashes of the anchors of all texts."""
    place, hashes, whole = chosen(w)
    place = np.unique(place[whole])
    return place, hashes[place]


def long_texts(w: common.Words) -> np.ndarray:
    return np.diff(w.first) >= PASSAGE


def probes(docs: DataFrame) -> DataFrame:
    """h, doc_id, block: the windows that each document probes with; block: it is one of its own non-overlapping blocks, too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts, ids = common.utf8(batch.column("text")), batch.column("doc_id").to_numpy()
            for a, b in common.runs(texts):
                w = common.Words(texts[a:b])
                place, h = anchors(w)
                row = np.searchsorted(w.first, place, "right") - 1
                place, h, row = (x[long_texts(w)[row]] for x in (place, h, row))
                block = (place - w.first[row]) % BLOCK == 0
                order = np.lexsort((~block, h, row))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                one = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(ids[a + row[one]]), pa.array(block[one])], ["h", "doc_id", "block"])

    return docs.select("doc_id", "text").mapInArrow(work, "h long, doc_id long, block boolean")


def index(found: DataFrame) -> DataFrame:
    """h, n, owner: what several documents probe with, and the smallest doc_id that has it as a reference block (null: none)."""
    owner = F.min(F.when(F.col("block"), F.col("doc_id"))).alias("owner")
    return found.groupBy("h").agg(F.count("*").alias("n"), owner).where("n > 1")


def windows(docs: DataFrame) -> DataFrame:
    """w, v, doc_id, tag: the passages around hits, by 128 bits of hash of their words; each once in a document.

    tag holds place, n and later in one number (see PLACE, N and LATER).

    A hit is a window that is a reference block of a smaller doc_id (`often` is negative). It is extended to both sides as
    far as all windows that probe the index are those of other documents, too (the column `found`), as they are in a
    repeat. later: the passage has a hit, as it has where it also starts in a smaller document; other passages are only
    what those of larger documents meet. n is the largest number of documents of its windows, the same for equal passages
    anywhere; place is the first one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts, ids = common.utf8(batch.column("text")), batch.column("doc_id").to_numpy()
            for a, b in common.runs(texts):
                w = common.Words(texts[a:b])
                known, first = np.unique(batch.column("found").slice(a, b - a).flatten().to_numpy(), return_index=True)
                times = np.abs(batch.column("often").slice(a, b - a).flatten().to_numpy()[first])
                place, hashes, whole = chosen(w)
                h = hashes[place].view(np.int64)
                near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                often = np.where(whole & (known[near] == h), times[near], 0)
                # which of its own hits have a smaller owner differs from text to text
                earlier = np.zeros(len(h), bool)
                for i in range(a, b):
                    lo, hi = w.first[i - a], min(w.first[i - a + 1], len(h))
                    signed = batch.column("often")[i].values.to_numpy()
                    smaller = np.sort(batch.column("found")[i].values.to_numpy()[signed < 0])
                    if hi > lo and len(smaller):
                        at = np.minimum(np.searchsorted(smaller, h[lo:hi]), len(smaller) - 1)
                        earlier[lo:hi] = smaller[at] == h[lo:hi]
                passage = common.rolling(common.prefix(w.hash), PASSAGE)
                at = np.arange(len(passage))  # a passage holds runs of blocks that begin at its first words
                many = PASSAGE - BLOCK * RUN + 1
                own = [often[k : k + len(at)] for k in range(many)] if len(at) else [at]
                most, least = np.max(own, axis=0), np.min(own, axis=0)
                later = np.any([earlier[k : k + len(at)] for k in range(many)], axis=0) if len(at) else at.astype(bool)
                stop = w.first[np.minimum(np.searchsorted(w.first, at, "right"), len(w.first) - 1)]
                at = at[(at + PASSAGE <= stop) & (least > 0)]
                row = np.searchsorted(w.first, at, "right") - 1
                order = np.lexsort((at, passage[at], row))
                at, row = at[order], row[order]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (passage[at[1:]] != passage[at[:-1]])
                at, row = at[new], row[new]
                tag = (at - w.first[row]) << 32 | np.minimum(most[at], 2**31 - 1) << 1 | later[at]
                other = common.span(common.prefix(common.mix(w.hash ^ OTHER)), at, at + PASSAGE)
                columns = [pa.array(passage[at].view(np.int64)), pa.array(other.view(np.int64)), pa.array(ids[a + row]), pa.array(tag.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["w", "v", "doc_id", "tag"])

    return docs.select("doc_id", "text", "found", "often").mapInArrow(work, "w long, v long, doc_id long, tag long")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of documents with the word sequence of a smaller doc_id, which has at least PASSAGE words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            w1, w2, many = common.digests(common.utf8(batch.column("text")))
            k = np.flatnonzero(many >= PASSAGE)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(k)), pa.array(w1[k]), pa.array(w2[k])], ["doc_id", "w1", "w2"])

    keyed = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, w1 long, w2 long")
    first = keyed.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").drop("last")
    return keyed.join(first, ["w1", "w2"]).where("doc_id > first").select("doc_id").distinct()


def everywhere(text: bytes, places: np.ndarray) -> np.ndarray:
    """All places of the passages that stand at these places of a text."""
    passage = common.rolling(common.prefix(common.Words([text]).hash), PASSAGE)
    return np.flatnonzero(np.isin(passage, passage[places[places < len(passage)]]))


def removed(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """n_words, n_removed and kept_text, from text, `places` (of repeated passages) and `whole` (everything goes)."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts, places, whole = common.utf8(batch.column("text")), batch.column("places"), batch.column("whole").to_pylist()
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if whole[i]:
                    gone[0] = 1
                elif places[i].is_valid:
                    at = everywhere(t, places[i].values.to_numpy())
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + PASSAGE, -1)
                stays = np.cumsum(gone)[:-1] == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words[k] for k in np.flatnonzero(stays)) if n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_words", "n_removed", "kept_text"])

    return docs.mapInArrow(work, f"{kinds}, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), split: int = SPLIT) -> DataFrame:
    """The columns `keep`, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row.

    A word goes if a passage of 50 words that covers it also starts in a document with a smaller doc_id; passages are
    judged on the input. Documents with the word sequence of a smaller one go at once. Of the others, non-overlapping blocks
    of five words are indexed (of the nine in a passage, the one with the smallest hash is enough) and rolling windows of
    every alignment probe the index (see chosen()). Hits are extended to maximal repeats: the union of the passages around
    them whose 50 words, by hash, also are around a hit of a smaller document. Counts are combined before their shuffle,
    and the join that follows can be split; a document gives each passage once; passages with a hit in more than `split`
    documents are dealt to several groups, whose first documents meet once more.

    Null texts have no words; rows without doc_id stay whole and don't make others go; rows with one doc_id never remove
    each other's words (of several texts with one doc_id, each loses what any of them would lose at its places, so ids
    should be unique). An empty table gives no rows. Columns other than doc_id, text and `keep` are not read. Texts of any
    length are one row's work.
    """
    base = docs if docs.schema["doc_id"].dataType.simpleString() == "bigint" else docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    base = base.select(*dict.fromkeys(("doc_id", "text", *keep)))
    named = base.where("doc_id is not null")
    whole = cut(copies(named))
    found = probes(named)
    signed = F.when(F.col("owner") < F.col("doc_id"), -F.col("n")).otherwise(F.col("n"))
    hits = found.select("h", "doc_id").join(index(found), "h").select("doc_id", "h", signed.alias("n"))
    hits = hits.groupBy("doc_id").agg(F.collect_list("h").alias("found"), F.collect_list("n").alias("often")).join(whole, "doc_id", "left_anti")
    many = F.expr(N)
    near = windows(named.join(hits, "doc_id")).withColumn("salt", F.when(many > split, F.pmod(F.xxhash64("doc_id"), F.ceil(many / split))).otherwise(0))
    judged = near.withColumn("first", F.min("doc_id").over(Window.partitionBy("w", "v", "salt")))
    # the smallest documents of each part of a split group meet once more; what is decided already stays apart
    again = F.when(F.col("doc_id") == F.col("first"), F.lit(0)).otherwise(F.xxhash64("doc_id", F.expr(PLACE)))
    met = judged.where((F.col("doc_id") > F.col("first")) | (many > split)).withColumn("again", again).withColumn("least", F.min("doc_id").over(Window.partitionBy("w", "v", "again")))
    repeats = met.where(f"{LATER} and (doc_id > first or doc_id > least)").groupBy("doc_id").agg(F.collect_list(F.expr(PLACE)).alias("places"))
    judged = named.join(repeats, "doc_id", "left").join(whole.withColumn("whole", F.lit(True)), "doc_id", "left")
    rest = base.where("doc_id is null").withColumns({"places": F.lit(None).cast("array<int>"), "whole": F.lit(None).cast("boolean")})
    return removed(judged.unionByName(rest), keep)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: SQL takes every passage of every text.
OP4_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
words AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM texts),
passages AS (SELECT doc_id, p, md5(w) AS w FROM
  (SELECT doc_id, n, p, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS w FROM words WHERE n >= 50) WHERE p <= n - 49),
firsts AS (SELECT w, min(doc_id) AS first FROM passages GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM passages JOIN firsts USING (w) WHERE first < doc_id),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS text, count(*) AS n FROM words t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept k USING (doc_id)
"""
