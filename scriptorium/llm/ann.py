"""Operator 7: nearest neighbours by hierarchical navigable small-world graphs, one for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .embeddings import usable, vectors

#: Vectors of a shard on average; queries answered together; query vectors brought to a shard in one group.
SHARD, TOGETHER, QUERIES = 8192, 256, 8192
#: Links chosen for a node and links that it can have on a level (twice as many on the lowest), candidates for them.
CHOSEN, LINKS, CANDIDATES = 16, 24, 64
#: Beam on the lowest level and above it; nodes expanded in a step.
BEAM, UPPER_BEAM, WIDTH = 160, 16, 4


class Graph:
    """x: unit vectors; levels: for each level its nodes, and a flat array of their neighbours (-1: none)."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels

    @classmethod
    def build(cls, x: np.ndarray, seed: int) -> Graph:
        """Levels are drawn as in an insertion; a shard is small enough to take a node's candidates from all of its level."""
        top = np.floor(-np.log(np.random.default_rng(seed).random(len(x))) / np.log(CHOSEN)).astype(int)
        return cls(x, [(nodes, links(x, nodes, 2 if level == 0 else 1)) for level in range(top.max(initial=0) + 1) if len(nodes := np.flatnonzero(top >= level))])

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities for each query, nearest first; a shard that fits into a beam is compared as a whole."""
        if len(self.x) <= beam:
            sims = q @ self.x.T
            order = np.argsort(-sims, axis=1, kind="stable")
            return order, np.take_along_axis(sims, order, 1)
        entry = np.repeat(self.levels[-1][0][:1][None, :], len(q), axis=0)
        for level in range(len(self.levels) - 1, -1, -1):
            nodes, near = self.levels[level]
            row = np.full(len(self.x), -1, np.int32)
            row[nodes] = np.arange(len(nodes))
            found, sims = walk(self.x, near, row, q, entry, beam if level == 0 else UPPER_BEAM)
            entry = found
        return found, sims


def links(x: np.ndarray, nodes: np.ndarray, factor: int) -> np.ndarray:
    """Neighbours of the nodes of a level: near ones that are nearer to the node than to each other, then the nearest."""
    n, chosen, most = len(nodes), CHOSEN * factor, LINKS * factor
    many = min(CANDIDATES, n - 1)
    out = np.full((n, most), -1, np.int32)
    if many <= 0:
        return out
    y = x[nodes]
    source, target, weight, rank = [], [], [], []
    for a in range(0, n, 256):
        block = y[a : a + 256]
        sims = block @ y.T
        sims[np.arange(len(block)), a + np.arange(len(block))] = -2
        cand = np.argpartition(-sims, many - 1, axis=1)[:, :many]
        value = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        cand, value = np.take_along_axis(cand, order, 1), np.take_along_axis(value, order, 1)
        among = np.einsum("bcd,bed->bce", y[cand], y[cand], optimize=False) if many < 8 else np.matmul(y[cand], y[cand].transpose(0, 2, 1))
        taken = np.zeros(cand.shape, bool)
        for j in range(many):
            taken[:, j] = ~((among[:, j, :] >= value[:, j, None]) & taken).any(axis=1)
        place = np.argsort(np.argsort(np.where(taken, 0, 1) * many + np.arange(many), axis=1), axis=1)
        keep = place < chosen
        r, c = np.nonzero(keep)
        source.append(a + r)
        target.append(cand[r, c])
        weight.append(value[r, c])
        rank.append(place[r, c])
    s, t, w, k = map(np.concatenate, (source, target, weight, rank))
    s, t, w, k = np.concatenate((s, t)), np.concatenate((t, s)), np.concatenate((w, w)), np.concatenate((k, np.full(len(k), many)))
    order = np.lexsort((k, t, s))
    s, t, w, k = s[order], t[order], w[order], k[order]
    new = np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))
    s, t, w, k = s[new], t[new], w[new], k[new]
    order = np.lexsort((-w, k, s))
    s, t = s[order], t[order]
    first = np.searchsorted(s, np.arange(n))
    place = np.arange(len(s)) - first[s]
    fits = place < most
    out[s[fits], place[fits]] = nodes[t[fits]]
    return out


def walk(x: np.ndarray, near: np.ndarray, row: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: each one expands its WIDTH nearest open nodes, until its beam has none."""
    many = len(q)
    seen = np.zeros((many, len(x) + 1), bool)  # one place for "no node"
    seen[:, -1] = True
    own = np.arange(many)
    node, sim = np.full((many, beam), -1, np.int64), np.full((many, beam), -np.inf, np.float32)
    closed = np.ones((many, beam), bool)

    def add(who: np.ndarray, new: np.ndarray) -> None:
        """Puts nodes into the beams of the queries `who`; those seen before don't count."""
        new = np.sort(new, axis=1)
        fresh = ~seen[who[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[who[:, None], new] = True
        value = np.where(fresh, np.einsum("bkd,bd->bk", x[new], q[who]), -np.inf)
        all_sim = np.concatenate((sim[who], value), axis=1)
        all_node = np.concatenate((node[who], np.where(fresh, new, -1)), axis=1)
        all_closed = np.concatenate((closed[who], ~fresh), axis=1)
        best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        sim[who], node[who], closed[who] = np.take_along_axis(all_sim, best, 1), np.take_along_axis(all_node, best, 1), np.take_along_axis(all_closed, best, 1)

    add(own, entry)
    while len(who := np.flatnonzero(~closed.all(axis=1))):
        open_sim = np.where(closed[who], -np.inf, sim[who])
        width = min(WIDTH, beam)
        pick = np.argpartition(-open_sim, width - 1, axis=1)[:, :width]
        use = np.isfinite(np.take_along_axis(open_sim, pick, 1))
        chosen = np.where(use, node[who[:, None], pick], -1)
        closed[who[:, None], pick] = True
        after = near[row[chosen]]
        after[~use] = -1
        add(who, after.reshape(len(who), -1))
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


def index(points: DataFrame) -> DataFrame:
    """points: shard, v, ids -> one row for each shard: vectors, ids and the graph's flat arrays."""

    def build(key, group):
        x = vectors(group.column("v"))
        order = np.lexsort(x.T[::-1])  # the same graph, however rows arrive
        x = np.ascontiguousarray(x[order])
        graph = Graph.build(unit(x), int(key[0].as_py()))
        return pa.table({
            "shard": [key[0].as_py()], "size": pa.array([x.shape[1]], pa.int32()), "v": pa.array([x.tobytes()], pa.binary()), "bytes": pa.array([x.itemsize], pa.int32()),
            "ids": pa.array([group.column("ids").combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "nodes": pa.array([[n.astype(np.int32).tobytes() for n, _ in graph.levels]], pa.list_(pa.binary())), "links": pa.array([[k.tobytes() for _, k in graph.levels]], pa.list_(pa.binary())),
        })

    return points.groupBy("shard").applyInArrow(build, "shard long, size int, v binary, bytes int, ids array<array<long>>, nodes array<binary>, links array<binary>")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) the k nearest rows but itself by cosine.

    Equal vectors are one node with their k + 1 smallest ids, so that a vector with very many copies takes one place. A
    shard's graph is built in one task of about `shard` nodes and kept as flat arrays in a table in the shared folder; the
    queries go to every shard, in groups of QUERIES at most on average, and the shards' k best are merged. Scores are
    double cosines of the original vectors; ties go to the smaller id. Vectors that are null, zero, hold null or
    non-finite components, or have another length than the query take no part; rows without id neither. Fewer candidates
    than k: all of them. Vectors keep their type: of array<double>, scores are those of the doubles. Repeated ids count once each. Empty tables give no rows. Recall depends on
    `beam`; the search is approximate, scores are not.
    """
    kind = "array<double>" if "double" in {df.schema[embedding].dataType.simpleString()[6:-1] for df in (rows, queries)} else "array<float>"
    ok = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(kind).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    points = ok(rows).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = cut(points.withColumn("size", F.size("v")))
    # each length of vectors has shards of its own
    counts = {r["size"]: r["n"] for r in points.groupBy("size").agg(F.count("*").alias("n")).collect()}
    shards, first = F.lit(None).cast("array<long>"), 0
    for size, n in sorted(counts.items()):
        more = -(-n // shard)
        shards = F.when(F.col("size") == size, F.sequence(F.lit(first).cast("long"), F.lit(first + more - 1).cast("long"))).otherwise(shards)
        first += more
    spread = points.withColumn("shards", shards)
    graphs = cut(index(spread.select(F.element_at("shards", (F.pmod(F.xxhash64("v"), F.size("shards")) + 1).cast("int")).alias("shard"), "v", "ids")))
    asked = cut(ok(queries).withColumn("size", F.size("v")))
    parts = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("shard", F.explode(shards)).select("shard", "part", "id", "v")
    held = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("long"))

    def search(key, questions, graph):
        if not questions.num_rows or not graph.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row = {c: graph.column(c)[0] for c in graph.column_names}
        x = np.frombuffer(row["v"].as_py(), np.float64 if row["bytes"].as_py() == 8 else np.float32).reshape(-1, row["size"].as_py())
        nodes = [np.frombuffer(b, np.int32) for b in row["nodes"].as_py()]
        net = Graph(unit(x), [(n, np.frombuffer(b, np.int32).reshape(len(n), -1)) for n, b in zip(nodes, row["links"].as_py())])
        ids, names = row["ids"].as_py(), questions.column("id").to_pylist()
        q, exact = vectors(questions.column("v")).astype(float), x.astype(float)
        norm, own_norm = np.sqrt((exact * exact).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        out: list[tuple[int, int, float]] = []
        for a in range(0, len(q), TOGETHER):
            found, _ = net.search(unit(q[a : a + TOGETHER]), beam)
            found = found[:, : 2 * k + 2]
            score = np.einsum("bkd,bd->bk", exact[found], q[a : a + TOGETHER]) / (norm[found] * own_norm[a : a + TOGETHER, None])
            for i in range(len(found)):
                own = [(-float(s), v) for f, s in zip(found[i], score[i]) if f >= 0 for v in ids[f] if v != names[a + i]]
                out += [(names[a + i], v, -s) for s, v in sorted(own)[:k]]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    hits = asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
