"""What the driver's Python takes for the classifier's training rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from scriptorium.llm import quality

WIDE = quality.TEXT + quality.META


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_feature_vectors_do_not_become_objects():
    x = np.random.default_rng(1).random((3000, WIDE)).astype(np.float32)
    rows = pa.chunked_array([pa.array(list(x[:1000]), pa.list_(pa.float32())), pa.array([], pa.list_(pa.float32())), pa.array(list(x[1000:]), pa.list_(pa.float32()))])
    got, most = peak(lambda: quality.matrix(rows))
    assert got.dtype == float and (got == x).all() and most < 1.3 * got.nbytes
    assert quality.matrix(rows.slice(990, 20)).tolist() == x[990:1010].tolist() and quality.matrix(rows.slice(0, 0)).shape == (0, WIDE)


def test_a_fit_holds_one_copy():
    x = np.random.default_rng(2).random((3000, WIDE))
    y = (x[:, 0] > 0.5).astype(float)
    model, most = peak(lambda: quality.Logistic(x, y, steps=20))
    assert most < 1.5 * x.nbytes
    z = np.column_stack((np.ones(len(x)), (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3)))
    assert np.allclose(model.logit(x), z @ model.weights) and peak(lambda: model.logit(x))[1] < 1.5 * x.nbytes
