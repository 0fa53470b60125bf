"""Sections of documents of any length: paragraphs are rows, and no task holds a document."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.positions import running
from scriptorium.plans.rules import RulePack
from scriptorium.sources.shared import written

#: Characters of a block: what one task folds of a document at a time.
BLOCK = 1 << 20


def measured(paragraphs: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, para_no and n of all paragraphs (doc_id, para_no, raw): characters of what cleaning leaves, as in
    sections.cleaned_array; 0 for those that go."""
    stays = (F.col("para_no") > 1) & ~T.is_timestamp(F.col("raw"), pack)
    text = F.when(stays, T.cleaned(F.col("raw"), pack))
    return paragraphs.select("doc_id", "para_no", F.coalesce(F.length(text), F.lit(0)).alias("n"))


class Blocks:
    """Blocks of some documents, one after the other: `order` (of the table's rows), `no`, `before`, `size`, `block` in it; for each
    row its block's end (`end`), and the end of the block's own rows (`own_end`), after which come those of the next block."""

    def __init__(self, table: pa.Table, more: pa.Table | None = None):
        ids = [table.column("doc_id"), *([more.column("doc_id")] if more is not None else [])]
        codes = pa.chunked_array([c for x in ids for c in x.chunks], ids[0].type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        doc, self.other = codes[: len(table)], codes[len(table) :]
        no, block, before, size, own = (table.column(c).to_numpy() for c in ("_no", "block", "_before", "n", "own"))
        self.order = np.lexsort((no, block, doc))
        self.doc, self.no, self.block, self.before, self.size, self.own = (x[self.order] for x in (doc, no, block, before, size, own))
        new = np.append(True, (np.diff(self.doc) != 0) | (np.diff(self.block) != 0))[: len(no)]
        self.first = np.flatnonzero(new)
        self.part = np.cumsum(new) - 1
        many = np.diff(np.append(self.first, len(no)))
        self.end = (self.first + many)[self.part]
        self.own_end = self.first[self.part] + np.bincount(self.part[self.own], minlength=len(self.first))[self.part]

    def next(self, most: int) -> np.ndarray:
        """For each paragraph, taken as a section's first, the next section's first one (its block's end: not among these)."""
        if not len(self.no):
            return self.no
        inside = self.before - self.before[self.first][self.part]
        apart = self.part * int((inside + self.size).max() + most + 1)  # blocks follow each other on one line
        return np.maximum(np.searchsorted(apart + inside + self.size, apart + inside + most, "right"), np.arange(len(self.no)) + 1)


def _blocks(rows: DataFrame, most: int, block: int) -> DataFrame:
    """Each paragraph in the block where it begins (own), and at a block's beginning also in the one before, whose sections reach there."""
    own = F.floor(F.col("_before") / block)
    reach = (own > 0) & (F.col("_before") - own * block <= most)
    places = F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.when(reach, F.struct((own - 1).alias("block"), F.lit(False).alias("own"))))
    return rows.select("doc_id", "para_no", "_no", "_before", "n", F.inline(F.filter(places, lambda p: p.isNotNull())))


def fold(paragraphs: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """doc_id, para_no, chunk_no of paragraphs (doc_id, para_no, n: characters): sections of at most `most` characters.

    A section begins where the next paragraph wouldn't fit; a paragraph that is longer is one by itself. Paragraphs know the
    characters before them from sums over range partitions. So a block of these finds each paragraph's next section by a
    search in its own sums, and for each paragraph where a section may begin first, the first beginning beyond the block: a
    pointer. Jumps along pointers, doubled each round, mark the beginnings that are met from a document's first one; with
    these, blocks fold by themselves. Rounds: the logarithm of the blocks of the longest document.

    Paragraphs without characters aren't allowed here; rows of a null doc_id are one document; an empty table gives none.
    """
    if block < most:
        raise ValueError("a block holds a section at least")
    kind = paragraphs.schema["doc_id"].dataType.simpleString()
    rows = written(_blocks(running(paragraphs.select("doc_id", "para_no", F.col("n").cast("long").alias("n")), ["doc_id"], ["para_no"], "n"), most, block))

    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = F.pmod(F.xxhash64("doc_id", "block"), F.lit(max(1, total // (4 * BLOCK)))).alias("task")  # small blocks share a task

    def pointers(_, group):
        b = Blocks(group)
        after, here = b.next(most), np.arange(len(b.no))
        last, to = np.where(after < b.own_end, after, here), after
        while len(last) and (last[last] != last).any():  # the last beginning in the block that each one leads to
            last = last[last]
        to = after[last]
        entry = np.flatnonzero(b.own & ((b.before - b.block * block <= most) | np.isin(here, b.first)))
        begin, to = last[entry], to[entry]
        known, at = to < b.end[entry], np.minimum(to, len(b.no) - 1)
        beyond = ~known & (b.size[begin] > most)  # of a long paragraph the end is known, though what follows isn't here
        to_no = np.where(known, b.no[at], np.where(beyond, b.no[begin] + 1, 0))
        place = np.where(known, b.before[at], b.before[begin] + b.size[begin])
        return pa.table({"doc_id": group.column("doc_id").take(pa.array(b.order[entry])), "block": pa.array(b.block[entry]), "no": pa.array(b.no[entry]), "to_block": pa.array(place // block), "to_no": pa.array(to_no)})

    jumps = written(rows.groupBy(tasks).applyInArrow(pointers, f"doc_id {kind}, block long, no long, to_block long, to_no long"))
    marked = jumps.where("no = 1").select("doc_id", "block", "no")
    longest = jumps.agg(F.max("block")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1))):
        a, b = jumps.alias("a"), jumps.alias("b")
        same = F.expr("a.doc_id <=> b.doc_id and a.to_block = b.block and a.to_no = b.no")
        m = marked.alias("m").join(a, F.expr("m.doc_id <=> a.doc_id and m.block = a.block and m.no = a.no")).select("a.doc_id", F.col("to_block").alias("block"), F.col("to_no").alias("no")).where("no > 0")
        marked = written(marked.unionByName(m).distinct())
        jumps = written(a.join(b, same).select("a.doc_id", "a.block", "a.no", "b.to_block", "b.to_no"))

    def begun(_, group, entries):
        b = Blocks(group, entries)
        after, own_end, begins = b.next(most).tolist(), b.own_end.tolist(), np.zeros(len(b.no), np.int64)
        starts: dict[tuple[int, int], int] = {}
        for doc, number, no in zip(b.other.tolist(), entries.column("block").to_pylist(), entries.column("no").to_pylist()):
            starts[doc, number] = min(no, starts.get((doc, number), no))  # one, or also a place after the last paragraph
        for f in b.first.tolist():
            no = starts.get((int(b.doc[f]), int(b.block[f])))
            at = f + int(np.searchsorted(b.no[f : b.own_end[f]], no)) if no is not None else own_end[f]
            while at < own_end[f]:
                begins[at] = 1
                at = after[at]
        upto = np.cumsum(begins)
        lead = (upto - begins)[b.first][b.part]
        all_of = np.bincount(b.part, begins, len(b.first)).astype(np.int64)[b.part]
        pick = np.flatnonzero(b.own)
        rows_of = pa.array(b.order[pick])
        return pa.table({"doc_id": group.column("doc_id").take(rows_of), "para_no": group.column("para_no").take(rows_of), "block": pa.array(b.block[pick]), "local": pa.array((upto - lead)[pick]), "begins": pa.array(all_of[pick])})

    para = paragraphs.schema["para_no"].dataType.simpleString()
    local = rows.groupBy(tasks).cogroup(marked.groupBy(tasks)).applyInArrow(begun, f"doc_id {kind}, para_no {para}, block long, local long, begins long")
    local = written(local)
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    lead = local.groupBy("doc_id", "block").agg(F.first("begins").alias("_begins")).select("doc_id", "block", F.coalesce(F.sum("_begins").over(earlier), F.lit(0)).alias("_lead"))
    out = local.alias("l").join(lead.alias("r"), F.expr("l.doc_id <=> r.doc_id and l.block = r.block"))
    return out.select("l.doc_id", "para_no", (F.col("local") + F.col("_lead")).alias("chunk_no"))


def sections(paragraphs: DataFrame, pack: RulePack, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, chunk_no, start_para, end_para, n_paras, chars of paragraphs (doc_id, para_no, raw): as sections.sections, for documents
    of any length. A section's end comes from a join with the next one's first paragraph, so no window goes over a document."""
    every = written(measured(paragraphs, pack))
    kept = every.where("n > 0")
    placed = fold(kept, pack.max_chars if most is None else most, block)
    own = placed.alias("p").join(kept.alias("k"), F.expr("p.doc_id <=> k.doc_id and p.para_no = k.para_no"))
    s = written(own.groupBy("p.doc_id", "chunk_no").agg(F.min("p.para_no").alias("first"), F.count("*").alias("n_paras"), F.sum("n").alias("chars")))
    total = every.groupBy("doc_id").agg(F.max("para_no").alias("last"))
    after = s.select(F.col("doc_id").alias("_doc"), (F.col("chunk_no") - 1).alias("_no"), (F.col("first") - 1).alias("_end"))
    out = s.join(after, F.expr("doc_id <=> _doc and chunk_no = _no"), "left").alias("s").join(total.alias("t"), F.expr("s.doc_id <=> t.doc_id"))
    return out.select("s.doc_id", "chunk_no", F.when(F.col("chunk_no") == 1, 1).otherwise(F.col("first")).alias("start_para"), F.coalesce("_end", "last").alias("end_para"), "n_paras", "chars")
