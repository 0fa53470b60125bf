"""Helpers shared by the training-data operators: reading, cutting lineage, vectorised hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, it is a temporary one in local mode and an error elsewhere."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="scriptorium-"))
    return _own_dir[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() made and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


# ---- 64-bit polynomial hashes of many spans at once ------------------------------------------------------------------

_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = [mix(np.arange(k, k + 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (1, 257)]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; span() makes hashes of any spans of them."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def rolling(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of that size."""
    n = len(sums) - 1 - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(sums))
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def byte_sums(data: np.ndarray, other: int = 0) -> np.ndarray:
    """Prefix sums of bytes; with other = 1, of a second table of values for the bytes."""
    return prefix(_BYTES[other][data])


#: Polynomials modulo 2**64 are alike for some regular strings of a thousand bytes and more; longer strings get digests.
SURE = 64


def byte_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes: digests of those longer than SURE, polynomials of the others."""
    out = span(byte_sums(data), start, end)
    for i in np.flatnonzero(end - start > SURE):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of each text's word sequence, and how many words it has."""
    both, many = bytearray(), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        many[i] = len(words)
        both += hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    halves = np.frombuffer(bytes(both), np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1], many


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a run of texts: `start` and `end` (bytes in `data`), `hash`, and `first` (of each text, and the end)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        full = ~_SPACE[self.data]
        step = np.diff(full.view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.hash = byte_spans(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.base)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: Bytes of text that are Python objects at a time in a worker, with their working arrays; a longer text by itself.
AT_ONCE = 1 << 18


def ranges(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about `most` together."""
    begin = size = end = 0
    for end, n in enumerate(sizes, 1):
        if end - 1 > begin and size + n > most:
            yield begin, end - 1
            begin, size = end - 1, 0
        size += n + 1
    if begin < end:
        yield begin, end


def runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, so that working arrays stay small."""
    return ranges(map(len, texts), most)


def slices(batches: Iterable[pa.RecordBatch], most: int = AT_ONCE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes of text: a whole batch as Python objects is larger than all working arrays."""
    for batch in batches:
        for a, b in ranges(pc.binary_length(batch.column(column)).fill_null(0).to_pylist(), most):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Strings as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups of these sizes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
