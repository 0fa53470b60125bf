"""Operator 9: near-duplicate embeddings by random-hyperplane sign hashing, with exact verification in blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import connected_components

COSINE = 0.9
#: Vectors of a cell, and of a bucket in it, on average; vectors of a cell above which it is split.
CELL, BUCKET, SPLIT = 32_768, 256, 65_536
#: The chance to miss a pair right at the threshold, half of it by cells and half by buckets; vectors compared in one block.
MISS, BLOCK = 0.005, 1024


def usable(column: str) -> F.Column:
    """Not null, of finite numbers, not zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return c.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(c, lambda x: x != 0)


def plan_tables(n: int, average: int, cosine: float = COSINE, miss: float = MISS / 2) -> tuple[int, int]:
    """Bits of a key, so that groups of unrelated vectors have `average` members, and tables, so that pairs at the threshold are met."""
    bits = max(0, math.ceil(math.log2(max(1, n) / average)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if bits == 0 else max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sign_keys(x: np.ndarray, bits: int, tables: int, seed: tuple[int, ...]) -> np.ndarray:
    """For each vector and table, the signs of its products with `bits` random hyperplanes, as a number."""
    planes = np.random.default_rng([*seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits)).astype(np.float32)
    signs = (x.astype(np.float32) @ planes > 0).reshape(len(x), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2) if bits else np.zeros((len(x), tables), np.int64)


def block_pairs(members: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Blocks of a bucket's members that are compared, and whether both are the same one: all of a whole cell (part: -1), and
    those of the first part with those of the second one where these have groups of their own."""
    first, second = (members, members) if not len(members) or part[members[0]] < 0 else (members[part[members] == 0], members[part[members] == 1])
    for p in range(0, len(first), BLOCK):
        for q in range(p if first is second else 0, len(second), BLOCK):
            yield first[p : p + BLOCK], second[q : q + BLOCK], first is second and p == q


def compare_cell(x: np.ndarray, copies: np.ndarray, part: np.ndarray, earlier: np.ndarray, cosine: float, seed: int, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a cell, the copies of others that it is linked with, and the first place of its local component.

    The cell's own tables deal it to buckets, which are compared in blocks. A pair is counted in the first bucket it shares,
    and not at all if it shares an earlier cell (`earlier`: keys of these). Vectors of one of a cell's two parts aren't compared,
    as that part has a group of its own (part: 0 and 1; all -1 for a whole cell).
    """
    n = len(x)
    bits, tables = plan_tables(n, bucket, cosine)
    fine = sign_keys(x, bits, tables, (seed, 1))
    norm = np.sqrt((x * x).sum(axis=1))
    links, edges = np.zeros(n, np.int64), []
    for t in range(tables):
        order = np.argsort(fine[:, t], kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(fine[order, t]) != 0)) if n else np.zeros(0, np.int64)
        for lo, hi in zip(edge, np.append(edge[1:], n)):
            for a, b, same in block_pairs(order[lo:hi], part):
                linked = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine
                i, j = np.nonzero(linked)
                i, j = a[i], b[j]
                fresh = (i < j) if same else np.ones(len(i), bool)
                i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                edges.append(np.stack(first_links(i, j)))
                fresh = np.ones(len(i), bool)
                for keys in (earlier, fine[:, :t]):
                    for s in range(keys.shape[1]):
                        fresh &= keys[i, s] != keys[j, s]
                i, j = i[fresh], j[fresh]
                links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
    label = np.arange(n)
    if edges:
        i, j = np.concatenate(edges, axis=1)
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return links, label


def first_links(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, smallest place of its component) of the graph with the links i, j: as many as there are places."""
    places, back = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = back[: len(i)], back[len(i) :]
    label = np.arange(len(places))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return places, places[label]
        label = new


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, seed: int = 7, cell: int = CELL, split: int = SPLIT, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors (by a digest of 128 bits) are one representative with a count. Hyperplane signs deal representatives to
    cells of about `cell` vectors, in several tables; within a cell, more hyperplanes deal them to buckets in tables of the
    cell's own, whose members are compared in double precision. So a vector moves once for each table of cells, which are
    few as cells are large, and not for each bucket. What decides where vectors go are ids and keys; vectors join them last.
    A cell of more than `split` vectors becomes groups of two blocks of it each: every link is counted, which takes a
    square of blocks where so many vectors are alike in all these signs. A pair that meets more than once counts the first
    time. Only counts by vector, and one link from each vector to the smallest of its local component, leave a group.

    Vectors that are null, zero, or hold null or non-finite components link with nothing (and are their own component);
    vectors of different lengths are never compared. A repeated vec_id gives a row each, linked if the vectors are alike;
    of different vectors with one vec_id, links and components count for the id. Ties don't matter; an empty table gives no
    rows. Other columns are ignored.
    """
    kind = "array<double>" if rows.schema[embedding].dataType.simpleString() == "array<double>" else "array<float>"
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v")).withColumn("ok", F.col("vec_id").isNotNull() & usable("v"))
    good = base.where("ok").select("vec_id", "v")
    bits, tables = plan_tables(good.count(), cell, cosine)

    def hashed(with_vectors: bool):
        def work(batches):
            for batch in batches:
                v, n = batch.column("v"), len(batch)
                size = np.diff(v.offsets.to_numpy())
                keys, names = np.zeros((n, tables), np.int64), bytearray()
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    keys[at] = sign_keys(vectors(v.take(pa.array(at))), bits, tables, (seed,))
                flat, begin = v.values.to_numpy(), v.offsets.to_numpy()
                flat = flat + flat.dtype.type(0)
                for i in range(n):
                    names += hashlib.blake2b(flat[begin[i] : begin[i + 1]], digest_size=16).digest()
                halves = np.frombuffer(bytes(names), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(keys.ravel().astype(np.int32)))
                columns = {"vec_id": batch.column("vec_id"), "d1": pa.array(halves[:, 0]), "d2": pa.array(halves[:, 1]), "size": pa.array(size.astype(np.int32))}
                columns |= {"v": v} if with_vectors else {"keys": lists}
                yield pa.RecordBatch.from_pydict(columns)

        return good.mapInArrow(work, "vec_id long, d1 long, d2 long, size int, " + (f"v {kind}" if with_vectors else "keys array<int>"))

    names = cut(hashed(False))
    groups = cut(names.groupBy("d1", "d2", "size").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("keys").alias("keys")))
    members = groups.select("*", F.posexplode("keys").alias("t", "key"))
    counts = members.groupBy("size", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.when(F.col("n") > split, F.ceil(F.col("n") * 2 / F.lit(split))).otherwise(1).cast("int")
    placed = members.join(counts, ["size", "t", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int"))
    # a member goes to the group of its block with each other block
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    full = hashed(True).join(spread.withColumnRenamed("rep", "vec_id"), ["vec_id", "d1", "d2", "size"])

    def compare(key, group):
        _, t, _, low, high = (x.as_py() for x in key)
        rep, d1 = group.column("vec_id").to_numpy(), group.column("d1").to_numpy()
        order = np.lexsort((d1, rep))
        new = np.append(True, (np.diff(rep[order]) != 0) | (np.diff(d1[order]) != 0))[: len(order)]
        pick = pa.array(order[new])  # a repeated row is there once
        rep, copies, block = (group.column(c).combine_chunks().take(pick).to_numpy() for c in ("vec_id", "copies", "block"))
        x, keys = (vectors(group.column(c).combine_chunks().take(pick)) for c in ("v", "keys"))
        part = np.where(block == low, 0, 1) if low != high else np.full(len(rep), -1)
        links, first = compare_cell(x.astype(float), copies, part, keys[:, :t], cosine, seed, bucket)
        return pa.table({"rep": rep, "links": links, "near": rep[first]})

    met = full.select("vec_id", "d1", "size", "copies", "v", "keys", "t", "key", "low", "high", "block").groupBy("size", "t", "key", "low", "high").applyInArrow(compare, "rep long, links long, near long")
    met = cut(met.where("links > 0 or near <> rep"))
    components = connected_components(met.where("near <> rep").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = groups.drop("keys").join(links, "rep", "left").join(components, groups["rep"] == components["id"], "left").select("d1", "d2", "size", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    found = names.drop("keys").join(classes, ["d1", "d2", "size"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"), (F.col("component") == F.col("vec_id")).alias("kept"))
    return found.unionByName(base.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: SQL compares all pairs, so it also has what hashing may miss.
OP9_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.other FROM reached r JOIN links l ON l.a = r.id)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id JOIN (SELECT id, min(other) AS component_id FROM reached GROUP BY id) c ON c.id = e.vec_id
"""
