"""Operators 7 and 9 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import ann, embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, v string, n int"


def fixture():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 900)] + 0.25 * rng.standard_normal((900, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [], [1.0, 0.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "x", 2) for i, v in rows], SCHEMA)


def cosines(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    norm = np.sqrt((x * x).sum(axis=1))
    return ids, x @ x.T / np.outer(norm, norm)


def check_links(rows, found, least):
    """Every count and component of links found; at least that share of all links."""
    ids, c = cosines(rows)
    linked = (c >= 0.9) & ~np.eye(len(ids), dtype=bool)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    want = {int(i): (int(n), int(ids[l])) for i, n, l in zip(ids, linked.sum(axis=1), label)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in found}
    assert len(found) == len(rows)
    assert all(got[i] == (0, i) for i, _ in rows if i not in want)
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(got[i][0] for i in want) >= least * sum(n for n, _ in want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sum(got[i] == x for i, x in want.items()) / len(want)


def test_near_duplicate_vectors(spark, monkeypatch):
    rows = fixture()
    assert check_links(rows, embeddings.near_duplicates(frame(spark, rows)).collect(), 0.98) > 0.95
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    for cell, split, bucket in ((1 << 15, 1 << 16, 16), (120, 1 << 16, 16), (120, 50, 32)):
        found = embeddings.near_duplicates(frame(spark, rows), cell=cell, split=split, bucket=bucket).collect()
        assert check_links(rows, found, 0.98) > 0.95


def test_parts_with_groups_of_their_own_are_compared_with_each_other_only(monkeypatch):
    rows = [r for r in fixture()[:900] if r[0] <= 100 or r[0] >= 160]
    _, c = cosines(rows)
    x, n = np.array([v for _, v in rows], np.float32).astype(float), len(rows)
    copies, part = np.random.default_rng(1).integers(1, 4, n), np.random.default_rng(2).integers(0, 2, n)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    compared = []
    pairs = embeddings.block_pairs
    monkeypatch.setattr(embeddings, "block_pairs", lambda m, p: ((a, b, same) for a, b, same in pairs(m, p) if compared.append((a, b)) is None))
    links, first = embeddings.compare_cell(x, copies, part, np.zeros((n, 0), np.int64), 0.9, 7, bucket=4 * n)
    linked = (c >= 0.9) & (part[:, None] != part[None, :])
    assert (links == linked @ copies).all()
    assert all((part[a] == 0).all() and (part[b] == 1).all() for a, b in compared) and sum(len(a) * len(b) for a, b in compared) == (part == 0).sum() * (part == 1).sum()
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert (first == label).all()


def test_planted_links_of_a_table(spark):
    """The table's vectors with copies at cosines from 0.85 to 0.99, and a chain: exact counts for all links above 0.92."""
    rng = np.random.default_rng(8)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    more = []
    for k in range(400):
        v = x[k % 150]
        noise = rng.standard_normal(x.shape[1])
        noise -= (noise @ v) * v
        c = rng.uniform(0.85, 0.99)
        more.append(c * v + np.sqrt(1 - c * c) * noise / np.sqrt(noise @ noise))
    chain = x[200]
    for _ in range(20):
        noise = rng.standard_normal(x.shape[1])
        noise -= (noise @ chain) * chain
        chain = 0.95 * chain + np.sqrt(1 - 0.95**2) * noise / np.sqrt(noise @ noise)
        more.append(chain)
    rows = [(i, [float(c) for c in np.array(v, np.float32)]) for i, v in enumerate([*x, *more])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for cell in (embeddings.CELL, 500):
        found = {r.vec_id: r for r in embeddings.near_duplicates(docs, cell=cell).collect()}
        y = np.array([v for _, v in rows], np.float32).astype(float)
        norm = np.sqrt((y * y).sum(axis=1))
        c = y @ y.T / np.outer(norm, norm)
        np.fill_diagonal(c, 0)
        sure, all_links = (c >= 0.92).sum(axis=1), (c >= 0.9).sum(axis=1)
        got = np.array([found[i].n_links for i in range(len(rows))])
        assert all_links.sum() > 500 and (got <= all_links).all() and (got >= sure).mean() > 0.998 and got.sum() >= 0.995 * all_links.sum()
        assert {found[i].component_id for i in range(len(rows) - 20, len(rows))} == {found[200].component_id}


def test_near_duplicate_vectors_of_a_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids = [(i, v) for i, v in rows]
    found = embeddings.op9_embedding_near_duplicates(spark, small).collect()
    assert len(found) == len(ids)


def recall(rows, found, step, k=5):
    ids, c = cosines(rows)
    place = {int(i): n for n, i in enumerate(ids)}
    hits = total = 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in place if i % step == 0}
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        order = sorted(((-c[place[q], n], int(i)) for n, i in enumerate(ids) if i != q))[:k]
        assert len(own) == len(order)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert r.score == pytest.approx(c[place[q], place[r.vec_id]], abs=1e-12)
            assert r.vec_id != q
        hits += sum(r.score >= -order[-1][0] - 1e-12 for r in own)
        total += len(order)
    return hits / total


@pytest.mark.parametrize("shard", [ann.SHARD, 200])
def test_nearest_neighbours(spark, shard):
    rows = fixture()
    f = frame(spark, rows)
    found = ann.nearest(f, f.where("vec_id % 7 = 0"), shard=shard).collect()
    kept = [r for r in found if r.query_id < 1000]
    assert recall([x for x in rows if x[0] < 1000], kept, 7) >= 0.98


def test_nearest_neighbours_of_a_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x = {i: v for i, v in rows}
    size = len(next(v for v in x.values() if v))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and len(v) == size and None not in v and np.isfinite(v).all() and any(v)]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    found = {}
    for r in ann.op7_nearest_neighbours(spark, d).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for n, i in enumerate(ids):
        if i % 50 == 0:
            s = m @ m[n]
            s[n] = -2
            best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
            hits += len(best & found[i])
            total += len(best)
    assert hits / total >= 0.95


def test_few_and_no_vectors(spark):
    f = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (0, [1.0, 0.0])])
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(f, f.where("vec_id = 0")).collect()) == [(0, 1, 1)]
    empty = f.where("vec_id > 5")
    assert ann.nearest(empty, empty).count() == 0
    assert embeddings.near_duplicates(empty).count() == 0
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(f).collect()) == [(0, 1, 0), (0, 1, 0), (1, 0, 1), (2, 0, 2)]


def test_links_do_not_depend_on_order_or_partitions(spark):
    rows = fixture()
    one = embeddings.near_duplicates(frame(spark, rows).repartition(1)).orderBy("vec_id").collect()
    assert one == embeddings.near_duplicates(frame(spark, rows[::-1]).repartition(7, F.col("vec_id"))).orderBy("vec_id").collect()


def test_doubles_keep_their_precision(spark):
    """Cosines of doubles that floats can't tell apart: order and links are those of the doubles."""
    x = [[1.0, 0.0], [1.0, 1e-9], [1.0, 0.4843221], [1.0, 0.48432210483785], [1.0, 2e-9]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(rows, rows.where("vec_id = 0"), k=4).orderBy("rank").collect()
    a = np.array(x)
    cosine = a @ a.T / np.outer(*[np.sqrt((a * a).sum(axis=1))] * 2)
    assert [r.vec_id for r in found] == sorted(range(1, 5), key=lambda i: (-cosine[0, i], i))
    assert [r.score for r in found] == pytest.approx([cosine[0, r.vec_id] for r in found], abs=1e-15)
    links = {r.vec_id: r.n_links for r in embeddings.near_duplicates(rows).collect()}
    assert links == {i: int((cosine[i] >= 0.9).sum()) - 1 for i in range(5)}
