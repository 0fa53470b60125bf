"""Operator 1: near-duplicate documents by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import cut, drop, table
from .components import connected_components

#: Words of a shingle, similarity of a link, coordinates of a signature in bands.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
#: Bytes of text whose signatures are made at a time; each run throws darts as often as its shortest text needs.
RUN = 1 << 20
#: Texts, and cells of their shingles, that meet in one block on each side.
TOGETHER, CELLS = 1024, 1 << 20
#: Texts with a rare cell in common that are paired one by one; where more have it, they meet in blocks.
FEW = 64


def regions(name: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The regions of weighted elements, cut into cells of height 1: hash, text and filled height of each cell.

    Only an element's uppermost cell may be filled in part. A cell's hash comes from its element and its number, so that
    texts which share a part of an element's region share its cells.
    """
    many = np.ceil(weight).astype(np.int64)
    cell = common.ragged(many)
    fill = np.minimum(1.0, np.repeat(weight, many) - cell)
    return common.mix(np.repeat(name, many) + cell.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), np.repeat(row, many), fill


def elements(words: common.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the weighted shingles of each text: an element is a shingle, its weight how often it occurs.

    A text of fewer words than a shingle has one shingle of all of them; a text without words has none.
    """
    sums = common.prefix(words.hash)
    count = np.diff(words.first)
    many = np.maximum(np.minimum(count, 1), count - size + 1)
    row = np.repeat(np.arange(len(count)), many)
    start = np.repeat(words.first[:-1], many) + common.ragged(many)
    end = np.minimum(start + size, words.first[row + 1])
    shingle = common.span(sums, start, end)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1]))[: len(row)])
    return regions(shingle[new], row[new], np.diff(np.append(new, len(row))).astype(float))


def signatures(cell: np.ndarray, row: np.ndarray, fill: np.ndarray, texts: int, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash: for each text and coordinate, the earliest dart in any element's region (0 for texts without elements).

    Darts hit a cell at the times of a Poisson process, each at a height, which the cell's hash alone decides: text A
    meets the same darts as text B in all regions that they share; a dart above the filled height misses. Each dart
    belongs to one coordinate. Only darts before a time that leaves few coordinates empty are thrown: about k ln k + 2k
    over the whole text, however many elements it has. Texts with an empty coordinate throw again, up to twice the time.
    """
    total = np.bincount(row, fill, minlength=texts)
    until = coordinates * (np.log(coordinates) + 2) / np.where(total > 0, total, 1)
    out = np.zeros((texts, coordinates), np.uint64)
    todo = total > 0
    while todo.any():
        alive = np.flatnonzero(todo[row])
        time = np.zeros(len(alive))
        first = np.full(texts * coordinates, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(alive):
            dart = common.mix(cell[alive] ^ np.uint64((step * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % (1 << 64)))
            time = time - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
            soon = time < until[row[alive]]
            alive, time, dart = alive[soon], time[soon], dart[soon]
            name = common.mix(dart)
            hit = (name >> np.uint64(40)).astype(float) < fill[alive] * (1 << 24)
            place = row[alive[hit]] * coordinates + (name[hit] % np.uint64(coordinates)).astype(np.int64)
            np.minimum.at(first, place, time[hit])
            darts.append((place, time[hit], name[hit]))
            step += 1
        for place, when, name in darts:
            won = when == first[place]
            out.ravel()[place[won]] = name[won] | np.uint64(1)
        empty = (first.reshape(texts, coordinates) == np.inf).any(axis=1)
        todo &= empty
        until[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :bands])
    return common.mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, pick, a digest of the word sequence in two halves (null without words), number of cells, and band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, RUN):
            texts = common.utf8(batch.column("text"))
            cell, row, fill = elements(common.Words(texts))
            keys = band_keys(signatures(cell, row, fill, len(texts)))
            w1, w2, many = common.digests(texts)
            whole = [pa.array(w, mask=many == 0) for w in (w1, w2)]
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "pick")), *whole, pa.array(np.bincount(row, minlength=len(texts))), lists], ["doc_id", "pick", "w1", "w2", "size", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("pick"), "text").mapInArrow(work, "doc_id long, pick long, w1 long, w2 long, size long, keys array<long>")


def element_lists(docs: DataFrame) -> DataFrame:
    """doc_id, the sorted hashes of the cells of its weighted shingles, which are all different, and their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            cell, row, _ = elements(common.Words(common.utf8(batch.column("text"))))
            order = np.lexsort((cell, row))
            bounds = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(cell[order].view(np.int64))), pa.array(np.diff(bounds))], ["doc_id", "elements", "cells"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, elements array<long>, cells int")


def verified(pairs: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least that: shared cells against cells of both.

    Neither side has a bound, so the joins are merge joins at every size.
    """
    left, right = (lists.select(F.col("doc_id").alias(i), F.col("elements").alias(e)).hint("merge") for i, e in (("a", "x"), ("b", "y")))
    # shared / (x + y - shared) >= similarity, written so that the cells are compared once
    return pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("x", "y")) * F.lit(1 + similarity) >= F.lit(similarity) * (F.size("x") + F.size("y")) - F.lit(1e-9)).select("a", "b")


def shared_cells(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], rows: int, columns: int, width: int = 4096) -> np.ndarray:
    """How many cells each of the texts of x shares with each of y: products of 0/1 matrices of `width` cells at a time."""
    (cell, row), (other, column) = x, y
    names = np.intersect1d(cell, other)
    at = [np.minimum(np.searchsorted(names, c), max(0, len(names) - 1)) for c in (cell, other)]
    out = np.zeros((rows, columns), np.float32)
    for low in range(0, len(names), width):
        sides = []
        for c, place, owner, n in ((cell, at[0], row, rows), (other, at[1], column, columns)):
            part = np.flatnonzero((names[place] == c) & (place >= low) & (place < low + width))
            side = np.zeros((n, width), np.float32)
            side[owner[part], place[part] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def reached(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links, the smallest row that can be reached (their number: none)."""
    n = len(linked)
    label = np.where(linked.any(axis=1), np.arange(n), n)
    while True:
        column = np.where(linked, label[:, None], n).min(axis=0, initial=n)
        new = np.minimum(label, np.where(linked, column[None, :], n).min(axis=1, initial=n))
        if (new == label).all():
            return label, column
        label = new


def rare_cells(held: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """cell, doc_id, component, cells, short: the rarest of each document's cells, as far as several documents have them.

    Let the cells of all documents be in one order, rare ones first. Two texts x and y, y not the smaller one, that are alike
    share `similarity` of y's cells at least, and 2 * similarity / (1 + similarity) of x's. So one of the cells that they share
    is among the first of each, as many as y and x may lack, and one more: for y all rows given here, for x those marked short.
    Cells of one document only take places in the order, but meet nothing; what very many texts have (a template) comes last.
    """
    own = lists.join(held.select("doc_id"), "doc_id", "left_semi").select("doc_id", "cells", F.explode("elements").alias("cell"))
    many = cut(own.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    first = lambda share: (F.col("cells") - F.ceil(F.lit(share) * F.col("cells") - F.lit(1e-6)) + 1).cast("int")
    shared = own.join(many, "cell").groupBy("doc_id", "cells").agg(F.array_sort(F.collect_list(F.struct("n", "cell"))).alias("shared")).withColumn("alone", F.col("cells") - F.size("shared"))
    rows = shared.select("doc_id", "cells", "alone", F.posexplode(F.slice("shared", 1, F.greatest(F.lit(0), first(similarity) - F.col("alone")))).alias("at", "s"))
    short = F.col("alone") + F.col("at") < first(2 * similarity / (1 + similarity))
    out = cut(rows.select("doc_id", "cells", F.col("s.cell").alias("cell"), short.alias("short")).join(held, "doc_id"))
    drop(many)
    return out


def candidates(members: DataFrame, lists: DataFrame, similarity: float, few: int) -> tuple[DataFrame, DataFrame]:
    """a, b: texts of different components that have one of their rarest cells in common, where at most `few` have it (so rows
    grow with the members); and doc_id of those with a rare cell that more have, which are left to across().

    members: leader, doc_id, component. Texts of one template that have nothing else in common meet nobody here.
    """
    mixed = members.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("high > low").select("leader")
    held = members.join(mixed, "leader", "left_semi").select("doc_id", "component").distinct()
    rare = rare_cells(held, lists, similarity)
    several = rare.groupBy("cell").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("high > low").select("cell", "n")
    groups = cut(rare.join(several, "cell"))
    drop(rare)
    x, y = (groups.where(F.col("n") <= few).alias(k) for k in "xy")
    ordered = F.struct("x.cells", "x.doc_id") < F.struct("y.cells", "y.doc_id")
    alike = F.col("x.cells") >= F.lit(similarity) * F.col("y.cells") - F.lit(1e-9)
    met = x.where("short").join(y, F.expr("x.cell = y.cell and x.component <> y.component") & ordered & alike)
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), groups.where(F.col("n") > few).select("doc_id").distinct()


def across(members: DataFrame, lists: DataFrame, similarity: float, together: int, cells: int) -> DataFrame:
    """a, b: links that join components, among the members (leader, doc_id, component) of each leader.

    Of a leader's members, those outside of its largest component are compared with all of other components, in blocks of
    about `together` texts and `cells` cells. A block gives its documents' links to one of their own component: rows out
    grow with the members, not with the pairs.
    """
    counts = members.groupBy("leader", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("leader").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components")).where("components > 1").drop("components")
    held = cut(members.join(main, "leader").join(lists.select("doc_id", "cells"), "doc_id").select("leader", "doc_id", "component", "cells", (F.col("component") != F.col("main")).alias("asks")))
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(together)), F.ceil(size / F.lit(cells))).cast("int")
    sizes = held.groupBy("leader").agg(
        blocks(F.count("*"), F.sum("cells")).alias("parts"), blocks(F.count_if("asks"), F.sum(F.when(F.col("asks"), F.col("cells")).otherwise(0))).alias("asking")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    placed = held.join(sizes, "leader").withColumns({"own_i": own("asking"), "own_j": own("parts")})
    # a document that asks goes to all parts, one that is asked to all that ask; where both are one block, it goes there once
    answers = placed.withColumn("j", F.col("own_j")).withColumn("i", every("asking")).withColumns({"asks": F.col("asks") & (F.col("i") == F.col("own_i")), "held": F.lit(True)})
    asked = placed.where("asks").withColumn("i", F.col("own_i")).withColumn("j", every("parts")).where("j <> own_j").withColumn("held", F.lit(False))
    spread = answers.unionByName(asked)

    def compare(key, group):
        doc, component, asks, held = (group.column(c).to_numpy() for c in ("doc_id", "component", "asks", "held"))
        listed = group.column("elements").combine_chunks()
        cell = listed.flatten().to_numpy()
        size = np.diff(listed.offsets.to_numpy())
        owner = np.repeat(np.arange(len(doc)), size)
        sides = []
        for mask in (asks.astype(bool), held.astype(bool)):
            number = np.cumsum(mask) - 1
            sides.append((np.flatnonzero(mask), (cell[mask[owner]], number[owner[mask[owner]]])))
        (ask, own_cells), (other, other_cells) = sides
        shared = shared_cells(own_cells, other_cells, len(ask), len(other))
        linked = shared >= similarity * (size[ask][:, None] + size[other][None, :] - shared) - 1e-9
        linked &= component[ask][:, None] != component[other][None, :]
        if not linked.any():
            return pa.table({"a": doc[:0], "b": doc[:0]})
        row, column = reached(linked)
        n = len(ask)
        a = np.concatenate((doc[ask][row[row < n]], doc[ask][column[column < n]]))
        b = np.concatenate((doc[ask][row < n], doc[other][column < n]))
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return spread.join(lists, "doc_id").select("leader", "i", "j", "doc_id", "component", "asks", "held", "elements").groupBy("leader", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, together: int = TOGETHER, cells: int = CELLS, few: int = FEW) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept for every row of docs (doc_id, text).

    A class is a connected component of links; a link joins equal word sequences, and texts with a weighted Jaccard
    similarity of their five-word shingles of at least `similarity` that share a band of their signatures (at 0.8, all but
    7 in a million do). Equal texts are one representative from then on. The leader of a band is its smallest doc_id.
    Members are verified against their leaders. Where members of one leader still are in several components, those that have
    one of their rarest shingles in common are compared (see candidates(); alike texts always have), in blocks where many have
    it (see across()), so that every candidate pair is linked, or in one class anyway, or found not to be alike.

    Texts without words (null, empty, white space) and rows without doc_id are classes of their own. A repeated doc_id
    gives a row each; of several texts with one doc_id, one (by a hash) stands for all. Other columns are ignored; an
    empty table gives no rows. A text of any length is one row's work, with 8 bytes for each of its words.
    """
    named = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    sketches = cut(sketch(named).where("w1 is not null"))
    known = cut(sketches.groupBy("doc_id").agg(F.min_by(F.struct("w1", "w2", "size"), "pick").alias("own")).select("doc_id", "own.*"))
    reps = known.groupBy("w1", "w2").agg(F.min("doc_id").alias("rep"))
    bands = sketches.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "w1", "w2"], "left_semi").select("doc_id", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("last > leader").drop("last")
    led = cut(bands.join(shared, "key").select("leader", "doc_id").distinct())
    texts = named.select("doc_id", F.xxhash64("text").alias("pick"), "text").join(led.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    lists = cut(element_lists(texts.groupBy("doc_id").agg(F.min_by("text", "pick").alias("text"))))
    # size rules out most pairs that only have a few shingles in common
    size_a, size_b = (known.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}")) for c in "ab")
    pairs = led.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).join(size_a, "a").join(size_b, "b")
    alike = F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b") - F.lit(1e-9)
    links = cut(verified(pairs.where(alike).select("a", "b"), lists, similarity))
    components = connected_components(links)
    members = led.join(components, led["doc_id"] == components["id"], "left").select("leader", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    members = cut(members)
    pairs, often = candidates(members, lists, similarity, few)
    more = verified(pairs, lists, similarity)
    if not often.isEmpty():
        more = more.unionByName(across(members.join(often, "doc_id", "left_semi"), lists, similarity, together, cells))
    more = cut(more)
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    drop(led, lists, links, members, more, sketches)
    classes = known.drop("size").join(reps, ["w1", "w2"]).join(components, F.col("rep") == components["id"], "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long")).join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
