"""Operator 5: repeated byte strings, by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import cut, table

#: Bytes of a repeated string (the depth of the sort); bytes of its leading digit.
DEPTH, LEAD = 100, 32
#: Suffixes' contexts sorted in one group; contexts of one leading digit above which its group is split.
GROUP, SPLIT = 4_000, 8_000
#: Longer texts are read in overlapping pieces of so many starts.
PIECE = 1 << 20


def units(texts: list[bytes]) -> list[tuple[int, int, bytes]]:
    """Texts in pieces (text, offset, bytes), so that each start of a string of DEPTH bytes is in one of them."""
    return [(i, o, t[o : o + PIECE + DEPTH - 1]) for i, t in enumerate(texts) if len(t) >= DEPTH for o in range(0, len(t) - DEPTH + 1, PIECE)]


class Leads:
    """The starts of strings of DEPTH bytes in a run of pieces, and the place of each one's leading digit.

    The leading digit of a string is the smallest of the hashes of its LEAD-byte substrings (the first of equals): it
    depends on the string alone, so that equal strings have equal leading digits at equal distances.
    """

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.base = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        self.hash = common.rolling(common.byte_sums(self.data), LEAD)
        n = len(self.data) - DEPTH + 1
        low = (self.hash & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.hash), dtype=np.uint64)
        size, want = 1, DEPTH - LEAD + 1
        while size * 2 <= want:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[want - size : want - size + n])
        at = np.arange(n)
        inside = at + DEPTH <= self.base[np.searchsorted(self.base, at, "right")]
        self.start = at[inside]
        self.place = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each place of a leading digit, and the first and last start that it leads."""
        first = np.flatnonzero(np.diff(self.place, prepend=-1) != 0)
        last = np.append(first[1:], len(self.place)) - 1
        return self.place[first], self.start[first], self.start[last[: len(first)]]


def leading(docs: DataFrame) -> DataFrame:
    """h, doc_id, place (byte): the leading digits of all strings of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_units, ids = units(common.utf8(batch.column("text"))), batch.column("doc_id").to_numpy()
            for a, b in common.runs([u[2] for u in all_units], PIECE):
                run = Leads([u[2] for u in all_units[a:b]])
                place, _, _ = run.groups()
                unit = np.searchsorted(run.base, place, "right") - 1
                row, offset = (np.array([u[k] for u in all_units[a:b]], np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(run.hash[place].view(np.int64)), pa.array(ids[row[unit]]), pa.array((offset[unit] + place - run.base[unit]).astype(np.int32))], ["h", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(work, "h long, doc_id long, place int")


def contexts(docs: DataFrame) -> DataFrame:
    """h, n, doc_id, start, many, bytes: for the leading digits in the columns `found` and `often` (how often each occurs), the bytes of all the strings that they lead."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_units, ids = units(common.utf8(batch.column("text"))), batch.column("doc_id").to_numpy()
            found, often = batch.column("found"), batch.column("often")
            for a, b in common.runs([u[2] for u in all_units], PIECE):
                part = all_units[a:b]
                lo, hi = part[0][0], part[-1][0] + 1
                known, first = np.unique(found.slice(lo, hi - lo).flatten().to_numpy(), return_index=True)
                times = often.slice(lo, hi - lo).flatten().to_numpy()[first]
                run = Leads([u[2] for u in part])
                place, begin, end = run.groups()
                h = run.hash[place].view(np.int64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                unit = np.searchsorted(run.base, place[hit], "right") - 1
                row, offset = (np.array([u[k] for u in part], np.int64) for k in (0, 1))
                raw = run.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[hit]), pa.array(times[at[hit]]), pa.array(ids[row[unit]]), pa.array((offset[unit] + begin[hit] - run.base[unit]).astype(np.int32)),
                        pa.array((end[hit] - begin[hit] + 1).astype(np.int32)), pa.array([raw[x : y + DEPTH] for x, y in zip(begin[hit].tolist(), end[hit].tolist())], pa.binary()),
                    ],
                    ["h", "n", "doc_id", "start", "many", "bytes"],
                )

    return docs.select("doc_id", "text", "found", "often").mapInArrow(work, "h long, n long, doc_id long, start int, many int, bytes binary")


def radix(group: np.ndarray, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refines groups of suffixes (which begin at these bytes of data) by one digit of 8 bytes after the other.

    The most significant digit comes first; singles leave at once, and only digits of those still there are read.
    Returns the suffixes that are left, ordered by group, and their groups: suffixes of one are equal through DEPTH bytes.
    """
    value = np.zeros(len(data), np.uint64)
    for k in range(8):
        value[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    alive = np.argsort(group, kind="stable")
    label, digit = group[alive], None
    for offset in (None, *range(0, DEPTH - 7, 8), *([DEPTH - 8] if DEPTH % 8 else [])):
        if offset is not None:
            digit = value[at[alive] + offset]
            order = np.lexsort((digit, label))
            alive, label, digit = alive[order], label[order], digit[order]
        new = np.ones(len(alive), bool)
        new[1:] = label[1:] != label[:-1]
        if digit is not None:
            new[1:] |= digit[1:] != digit[:-1]
        name = np.cumsum(new) - 1
        many = np.bincount(name)[name] > 1 if len(name) else name.astype(bool)
        alive, label = alive[many], name[many]
    return alive, label


def first_of(name: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by name and occurrence, the first of the same name for each place in it, and what is a later occurrence."""
    order = np.lexsort((start, doc, name))
    name, doc, start = name[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = name[1:] != name[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, new, (doc != doc[first]) | (start != start[first])  # a repeated row is not later


def judge(key, group):
    """Sorts the suffixes of a group's contexts: spans of bytes with an earlier equal string, and what stays of split groups.

    Of equal contexts, all but the first go at once; suffixes of the different contexts of one leading digit are sorted.
    """
    h, parted, doc, start, many = (group.column(c).to_numpy() for c in ("h", "parted", "doc_id", "start", "many"))
    raw = group.column("bytes").combine_chunks()
    order, new, later = first_of(raw.dictionary_encode().indices.to_numpy(), doc, start)
    gone, lead = order[later], order[new]
    _, digit = np.unique(h[lead], return_inverse=True)
    alone = np.bincount(digit)[digit] == 1
    only, digit, lead = lead[alone], digit[~alone], lead[~alone]
    spans = [{"kind": 0, "at": gone, "step": 0, "many": many[gone]}, {"kind": 1, "at": only[parted[only]], "step": 0, "many": many[only[parted[only]]]}]
    if len(lead):
        data = np.frombuffer(b"".join(raw.take(pa.array(lead)).to_pylist()), np.uint8)
        size = many[lead]
        base = np.concatenate(([0], np.cumsum(size + DEPTH - 1)))[:-1]
        row, step = np.repeat(np.arange(len(lead)), size), common.ragged(size)
        # strings of one leading digit stand at different distances from it, which is a digit, too
        alive, name = radix(digit[row], base[row] + step, data)
        order, _, later = first_of(name, doc[lead[row[alive]]], start[lead[row[alive]]] + step[alive])
        mark = np.zeros(len(row), bool)
        mark[alive[order[later]]] = True
        for kind, mask in ((0, mark), (1, ~mark & parted[lead][row])):
            edge = np.flatnonzero(mask)
            fresh = np.ones(len(edge), bool)
            fresh[1:] = (np.diff(edge) != 1) | (np.diff(row[edge]) != 0)
            head, tail = edge[fresh], edge[np.append(fresh[1:], True)[: len(edge)]]
            spans.append({"kind": kind, "at": lead[row[head]], "step": step[head], "many": tail - head + 1})
    tables = []
    for s in spans:
        at, step, size = s["at"], np.broadcast_to(s["step"], len(s["at"])), s["many"]
        bytes_ = [raw[i].as_py()[x : x + n + DEPTH - 1] for i, x, n in zip(at.tolist(), step.tolist(), size.tolist())] if s["kind"] else [b""] * len(at)
        tables.append(pa.table({
            "kind": pa.array(np.full(len(at), s["kind"], np.int32)), "h": pa.array(h[at]), "parted": pa.array(np.zeros(len(at), bool)), "doc_id": pa.array(doc[at]),
            "start": pa.array((start[at] + step).astype(np.int32)), "many": pa.array(size.astype(np.int32)), "bytes": pa.array(bytes_, pa.binary()),
        }))
    return pa.concat_tables(tables)


def strings(contexts: DataFrame) -> DataFrame:
    """w1, w2, doc_id, start: every string of DEPTH bytes in contexts, by a hash of 128 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many_of, raw = batch.column("many").to_numpy(), batch.column("bytes").to_pylist()
            for a, b in common.runs(raw):
                many = many_of[a:b]
                data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
                base = np.concatenate(([0], np.cumsum(many + DEPTH - 1)))[:-1]
                row, step = np.repeat(np.arange(b - a), many), common.ragged(many)
                at = base[row] + step
                keys = [pa.array(common.rolling(sums, DEPTH)[at].view(np.int64)) for sums in (common.byte_sums(data), common.byte_sums(data, 1))]
                doc, start = (batch.column(c).to_numpy()[a:b] for c in ("doc_id", "start"))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(doc[row]), pa.array((start[row] + step).astype(np.int32))], ["w1", "w2", "doc_id", "start"])

    return contexts.select("doc_id", "start", "many", "bytes").mapInArrow(work, "w1 long, w2 long, doc_id long, start int")


JUDGED = "kind int, h long, parted boolean, doc_id long, start int, many int, bytes binary"


def removed(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_bytes, from text, `spans` (start, many) and `whole` (everything goes)."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, many, whole = common.utf8(batch.column("text")), batch.column("starts"), batch.column("many"), batch.column("whole").to_pylist()
            out = []
            for i, t in enumerate(texts):
                if whole[i] or not starts[i].is_valid:
                    out.append((len(t), len(t) if whole[i] else 0, int(bool(whole[i])), b"" if whole[i] else t))
                    continue
                gone = np.zeros(len(t) + 1, np.int64)
                begin = starts[i].values.to_numpy()
                np.add.at(gone, np.minimum(begin, len(t)), 1)
                np.add.at(gone, np.minimum(begin + many[i].values.to_numpy() + DEPTH - 1, len(t)), -1)
                gone = np.cumsum(gone)[:-1] > 0
                out.append((len(t), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], [*keep, "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return docs.mapInArrow(work, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_bytes binary")


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), group: int = GROUP, split: int = SPLIT) -> DataFrame:
    """The columns `keep`, n_bytes, n_removed, n_spans and kept_bytes of every row; texts are UTF-8 bytes.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document with a smaller doc_id, or
    before in the same one; strings are judged on the input. Equal whole texts of a smaller doc_id go at once. The sort is
    by most significant digit first: the leading digit (see Leads) deals suffixes to groups, in which passes over 8 bytes
    at a time refine groups of equal suffixes, down to 100 bytes; groups with one member leave after every pass. Only
    leading digits that occur twice get past the first pass, and travel with the bytes of their strings (about 170 for 70
    suffixes). A digit that occurs more than `split` times is dealt to several groups; the first of each group's equal
    strings meet in another pass, by digit, or, where more than `split` contexts of a digit are left, by the 128-bit hash
    of their own 100 bytes: strings that differ don't share a group, and of copies each group left one.

    Null texts are empty; rows without doc_id stay whole; several rows of one doc_id and text are treated alike in each, of
    several texts with one doc_id each loses what any of them would lose at its places (ids should be unique). An empty
    table gives no rows. Columns other than doc_id, text and `keep` are not read. Long texts are read in pieces.
    """
    base = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*dict.fromkeys(("doc_id", "text", *keep)))
    named = base.where("doc_id is not null")
    keyed = named.select("doc_id", F.sha2("text", 256).alias("key"), F.octet_length("text").alias("size")).where(F.col("size") >= DEPTH)
    twins = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    whole = cut(keyed.join(twins, "key").where("doc_id > first").select("doc_id").distinct())
    found = leading(named)
    known = cut(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    total, most = known.agg(F.sum("n"), F.max("n")).first()
    buckets = max(16, (total or 0) // group)
    # rows move as they are: lists that are begun before the shuffle take more room
    hits = found.select("h", "doc_id").join(known, "h").repartition("doc_id").groupBy("doc_id").agg(F.collect_list("h").alias("found"), F.collect_list("n").alias("often")).join(whole, "doc_id", "left_anti")
    bucket = F.pmod(F.xxhash64("h"), F.lit(buckets))
    near = contexts(named.join(hits, "doc_id")).withColumn("bucket", bucket).withColumn("parted", F.col("n") > split)
    near = near.withColumn("salt", F.when(F.col("parted"), F.pmod(F.xxhash64("doc_id", "start"), F.ceil(F.col("n") / group))).otherwise(0)).drop("n")
    judged = near.groupBy("bucket", "salt").applyInArrow(judge, JUDGED)
    if (most or 0) > split:
        judged = cut(judged)  # read three times
        left = judged.where("kind = 1").drop("kind")
        crowded = cut(left.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > split).select("h"))
        again = left.join(crowded, "h", "left_anti").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(judge, JUDGED)
        first = Window.partitionBy("w1", "w2")
        met = strings(left.join(crowded, "h", "left_semi")).withColumn("first", F.min(F.struct("doc_id", "start")).over(first))
        later = met.where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start", F.lit(1).alias("many"))
        judged = judged.unionByName(again).where("kind = 0").select("doc_id", "start", "many").unionByName(later)
    spans = judged.select("doc_id", "start", "many")
    repeats = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("many").alias("many"))
    with_spans = named.join(repeats, "doc_id", "left").join(whole.withColumn("whole", F.lit(True)), "doc_id", "left")
    rest = base.where("doc_id is null").withColumns({"starts": F.lit(None).cast("array<int>"), "many": F.lit(None).cast("array<int>"), "whole": F.lit(None).cast("boolean")})
    return removed(with_spans.unionByName(rest), keep)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
