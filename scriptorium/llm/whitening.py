"""Operator 11: embeddings whitened along leading eigenvectors, by Chebyshev-filtered subspace iteration over Spark passes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table

COMPONENTS = 32
#: Entries are integers floor(SCALE * c); what would lie beyond MOST is held there.
SCALE, MOST = 64, 1 << 40
#: The block has half as many vectors again as are wanted, and so many at least; products of a filter; bytes of a block of rows.
GUARD, DEGREE, BLOCK = 8, 10, 1 << 20
#: A filter may enlarge the first wanted vector so many times more than the last one, or rounding drowns that.
RANGE = 1e8
#: Partial sums that the driver adds up itself; more are first summed in groups by tasks.
DIRECT = 128


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(float)), -MOST, MOST).astype(np.int64)


def usable(column: str) -> F.Column:
    """Not null, not empty, all entries finite."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & F.coalesce(~bad, F.lit(False)) & (F.size(c) > 0)


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of a batch's vectors of each length, and their entries as integers."""
    size = np.diff(column.offsets.to_numpy())
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        same = column if len(at) == len(size) else column.take(pa.array(at))
        out.append((at, integers(same.flatten().to_numpy(zero_copy_only=False)).reshape(len(at), d)))
    return out


def blocks(points: DataFrame) -> DataFrame:
    """Blocks of rows as bytes (size, rows, wide, data), with each block's sums. Small integers take four bytes."""

    def work(batches):
        for batch in batches:
            for _, x in by_length(batch.column("v")):
                step = max(1, BLOCK // (4 * x.shape[1]))
                for a in range(0, len(x), step):
                    part = x[a : a + step]
                    wide = bool((np.abs(part) >= 1 << 31).any())
                    yield pa.RecordBatch.from_pydict({
                        "size": pa.array([x.shape[1]], pa.int32()), "rows": pa.array([len(part)], pa.int64()), "wide": [wide],
                        "sums": pa.array([part.sum(axis=0)], pa.list_(pa.int64())), "data": pa.array([part.astype(np.int64 if wide else np.int32).tobytes()], pa.binary()),
                    })

    return points.select("v").mapInArrow(work, "size int, rows long, wide boolean, sums array<long>, data binary")


class Fit:
    """The fit list of vectors of one length: blocks, number, and the sums as q * n + r."""

    def __init__(self, held: DataFrame, size: int, n: int, sums: list[int]):
        self.held, self.size, self.n, self.sums = held.where(F.col("size") == size), size, n, sums
        self.quotient = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.parts = max(1, held.rdd.getNumPartitions())

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        quotient, part = self.quotient, self.rest / self.n
        return lambda x: (x - quotient) - part  # integers first: nothing cancels

    def summed(self, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of f(centred rows) over all blocks: one pass, an array from each task."""
        centre, size = self.centre(), self.size

        def partial(batches):
            total = np.zeros(shape)
            for batch in batches:
                for data, wide in zip(batch.column("data"), batch.column("wide")):
                    x = np.frombuffer(data.as_buffer(), np.int64 if wide.as_py() else np.int32).reshape(-1, size)
                    total += f(centre(x))
            yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

        def added(batches):
            total = np.zeros(shape)
            for batch in batches:
                for x in batch.column("sum"):
                    total += np.frombuffer(x.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

        sums, left = self.held.select("wide", "data").mapInArrow(partial, "sum binary"), self.parts
        while left > DIRECT:
            left = -(-left // 32)
            sums = sums.repartition(left).mapInArrow(added, "sum binary")
        return sum(np.frombuffer(r["sum"]).reshape(shape) for r in sums.collect())

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q."""
        return self.summed(lambda c: c.T @ (c @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: np.array([(c * c).sum()]), (1,))[0]) / self.n


class Lanczos:
    """A vector that rides along with the block's products and learns where the spectrum begins."""

    def __init__(self, d: int, rng: np.random.Generator):
        x = rng.standard_normal(d)
        self.basis, self.alpha, self.beta = [x / np.linalg.norm(x)], [], []

    def step(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ product))
        w = product - self.alpha[-1] * v
        for _ in range(2):
            w -= np.array(self.basis).T @ (np.array(self.basis) @ w)
        self.beta.append(float(np.linalg.norm(w)))
        self.basis.append(w / self.beta[-1] if self.beta[-1] > 0 else w)

    def low(self) -> float:
        """The least Ritz value less its residual; eigenvalues of a covariance aren't below 0."""
        if not self.alpha:
            return 0.0
        value, vector = np.linalg.eigh(np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1))
        return max(0.0, value[0] - self.beta[-1] * abs(vector[-1, 0]))


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors of a covariance that is known by its products only.

    A block of vectors goes through a Chebyshev polynomial of the covariance (three-term recurrence, a product each) that is
    small on [low, the block's least Ritz value] and grows fast above, then through QR and Rayleigh-Ritz. It ends when every
    wanted pair's residual is certified to be at the level of rounding. Should it not get there, the block grows, at last to
    the whole space, where Rayleigh-Ritz is exact.
    """
    rng = np.random.default_rng(seed)
    m = min(d, wanted + max(GUARD, wanted // 2))
    q, lanczos = np.linalg.qr(rng.standard_normal((d, m)))[0], Lanczos(d, rng)

    def multiply(x: np.ndarray) -> np.ndarray:
        if len(lanczos.alpha) >= min(d, 2 * DEGREE) or lanczos.beta and lanczos.beta[-1] <= 1e-12 * max(lanczos.alpha):
            return product(x)
        both = product(np.column_stack((x, lanczos.basis[-1])))
        lanczos.step(both[:, -1])
        return both[:, :-1]

    vq, before, rounds = multiply(q), np.inf, 0
    while True:
        value, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(value[0], 0.0)
        residual = np.linalg.norm(vq - q * value, axis=0)[:wanted].max()
        if residual <= 2e-14 * top or residual <= 1e-11 * top and residual > before / 2 or len(value) == d:
            return value[:wanted], q[:, :wanted] / np.linalg.norm(q[:, :wanted], axis=0)
        before, rounds = residual, rounds + 1
        if rounds % 12 == 0:  # too slow: a larger block
            q = np.linalg.qr(np.column_stack((q, rng.standard_normal((d, min(d, 2 * len(value)) - len(value))))))[0]
            vq, before = multiply(q), np.inf
            continue
        low, cut_off = min(lanczos.low(), value[-1]), value[-1]
        half, middle = max((cut_off - low) / 2, 1e-15 * top), (cut_off + low) / 2
        growth = np.arccosh(np.maximum((np.array([top, value[wanted - 1]]) - middle) / half, 1))
        degree = int(np.clip(np.log(RANGE) / max(growth[0] - growth[1], 1e-3), 2, DEGREE))
        first = scale = half / max(top - middle, half)
        old, new = q, (vq - middle * q) * (scale / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - scale)
            old, new = new, 2 * after / half * (multiply(new) - middle * new) - scale * after * old
            scale = after
        q = np.linalg.qr(new / np.maximum(np.linalg.norm(new, axis=0), 1e-300))[0]
        vq = multiply(q)


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error: a row for each usable row.

    Entries c become floor(64 * c); all usable vectors are the fit list. n: how many they are; deviation, decimal(38,0): the
    sum of (n * x - S)^2, exact; whitened and explained, arrays: for each component (falling eigenvalues of the covariance)
    the centred vector projected on it, over the eigenvalue's root, and the eigenvalue's share of the trace; identity_error:
    of the covariance of `whitened`, the entry furthest from the identity's, measured in a pass.

    Rows are kept once, as blocks of small integers in the shared folder; each product with the covariance is a pass over
    these in which a task sends one array (length x block). The model is length x components numbers; nothing else is
    broadcast.

    Vectors that are null or empty or hold null, NaN or infinite entries are left out; zero vectors are in. Vectors of each
    length are a fit list of their own. Entries that give over 2^40 count as 2^40. Where all vectors are alike in a
    direction there is no component: arrays are as long as the covariance has positive eigenvalues (above length *
    rounding), at most `components`; a single vector has none. Equal eigenvalues: some basis of their space. Rows without
    id, repeated rows and ids give a row each; an empty table none. Other columns are ignored. An exact deviation of more
    than 38 digits is an error.
    """
    kind = rows.schema[vec_id].dataType.simpleString()
    points = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(usable("v"))
    held = cut(blocks(points))
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in held.select("size", "rows", F.posexplode("sums").alias("at", "s")).groupBy("size", "at").agg(F.sum("rows").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("size", "at").collect():
        totals.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    models = {size: model(Fit(held, size, n, sums), components) for size, (n, sums) in totals.items()}
    drop(held)
    schema = f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"

    def work(batches):
        for batch in batches:
            for at, x in by_length(batch.column("v")):
                n, quotient, rest, axes, explained, error = models[x.shape[1]]
                moved = x - quotient
                wide = n * (int(np.abs(moved).max(initial=0)) + 1)
                exact = moved * n - rest if wide < 1 << 62 else moved.astype(object) * n - rest.astype(object)
                if wide * wide * x.shape[1] < 1 << 62:
                    deviation = pa.array((exact * exact).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([sum(int(e) ** 2 for e in row) for row in exact], pa.decimal128(38, 0))
                z, k = (moved - rest / n) @ axes, axes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(z.ravel()))
                same = pa.array([explained.tolist()] * len(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(x), n)), deviation, lists, same, pa.array(np.full(len(x), error))], ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return points.mapInArrow(work, schema)


def model(fit: Fit, components: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """n, quotient, rest, whitening axes (length x components), shares of the trace, largest entry of the error."""
    trace = fit.trace()
    value, vector = leading(fit.product, fit.size, min(components, fit.size)) if trace > 0 else (np.zeros(0), np.zeros((fit.size, 0)))
    there = value > fit.size * np.finfo(float).eps * trace
    value, vector = value[there], vector[:, there]
    axes = vector / np.sqrt(value)
    error = 0.0
    if len(value):
        error = float(np.abs(fit.summed(lambda c: (z := c @ axes).T @ z, (len(value), len(value))) / fit.n - np.eye(len(value))).max())
    return fit.n, fit.quotient, fit.rest, axes, value / trace if trace else value, error


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    each = out.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(F.col("vec_id").cast("long"), (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").cast("long"), F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
