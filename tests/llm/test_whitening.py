"""Operator 11 against exact integers and numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium import llm
from scriptorium.llm import whitening


def plain(rows):
    """n, deviations, whitened vectors (up to signs), shares: of the usable vectors of one length."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    return n, deviation, centred @ vector / np.sqrt(np.maximum(value, 1e-300)), value / value.sum()


@pytest.mark.parametrize("d", [5, 48, 80])
def test_whitened_vectors(spark, d):
    rng = np.random.default_rng(d)
    x = (rng.standard_normal((700, d)) * np.linspace(1, 3, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    odd = [None, [], [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(None, [0.0] * d), (3, [float(c) for c in x[3]]), (3, [1.0] * d)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + [(9000 + i, v) for i, v in enumerate(odd)]], "vec_id long, embedding array<double>, n long, whitened int").repartition(5)
    found = whitening.whiten(table).collect()
    assert len(found) == len(rows)
    n, deviation, whitened, share = plain([v for _, v in rows])
    want = sorted((-1 if i is None else i, int(e), tuple(w)) for (i, _), e, w in zip(rows, deviation, whitened[:, :32].tolist()))
    got = sorted((-1 if r.vec_id is None else r.vec_id, int(r.deviation), tuple(r.whitened)) for r in found)
    assert {r.n for r in found} == {n} and {r.identity_error for r in found} <= {found[0].identity_error} and found[0].identity_error < 1e-9
    assert [x[:2] for x in got] == [x[:2] for x in want]
    a, b = np.array([x[2] for x in got]), np.array([x[2] for x in want])
    assert a.shape == b.shape == (n, min(d, 32))
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-7
    assert np.abs(np.array(found[0].explained) / share[:32] - 1).max() < 1e-12


def test_vectors_without_spread_or_of_other_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0] * 3), (4, [1e300, -1e300, 1.0, 0.0]), (5, [0.0, 1.0, 1.0, 0.5])]
    found = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert (found[1].n, found[1].deviation, [abs(x) for x in found[1].whitened], found[1].explained) == (2, 128**2, [1.0], [1.0])
    assert (found[3].n, found[3].deviation, found[3].whitened) == (1, 0, [])
    most = whitening.MOST
    assert found[4].deviation == most**2 + (most + 64) ** 2 + 32**2
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_iteration_on_hard_spectra():
    rng = np.random.default_rng(0)
    for spectrum in (np.r_[np.ones(5), np.zeros(195)], 1 / np.arange(1, 301) ** 2, np.ones(100), np.r_[np.full(40, 5.0), np.ones(60)], np.linspace(1, 1.1, 200)):
        basis = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
        v = (basis * spectrum) @ basis.T
        value, vector = whitening.leading(lambda q: v @ q, len(spectrum), 32)
        assert np.abs(value - np.sort(spectrum)[::-1][:32]).max() < 1e-12
        assert np.abs(v @ vector - vector * value).max() < 1e-10 and np.abs(vector.T @ vector - np.eye(32)).max() < 1e-10


def test_sums_in_groups_of_tasks(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").repartition(40)
    monkeypatch.setattr(whitening, "DIRECT", 3)
    assert max(r.identity_error for r in whitening.whiten(rows).collect()) < 1e-9


def test_query_equals_plain_version(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, whitened, share = plain([r.embedding for r in rows])
    found = llm.QUERIES["op11_whitening"](spark, small)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    k = min(32, n - 1)
    assert found.count() == n * k
    each = {(r.vec_id, r.component): r for r in found.where(F.col("component") <= k).collect()}
    for c in range(1, k + 1):
        a = np.array([each[r.vec_id, c].whitened for r in rows])
        b = whitened[:, c - 1]
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-7
        assert abs(each[rows[0].vec_id, c].explained / share[c - 1] - 1) < 1e-10
    assert [each[r.vec_id, 1].deviation for r in rows] == deviation
