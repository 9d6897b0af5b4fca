"""Helpers shared by the training-data operators.

Text reaches the Python operators as Arrow batches (``mapInArrow``); every
helper here keeps at most one batch, or one bounded chunk, in memory.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Bytes after which a batch ends.
BATCH_BYTES = 8 << 20
#: Text bytes handled at once by the vectorised operators.
CHUNK_BYTES = 900_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def py_crc_mod(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Apply ``make()(columns)`` to each Arrow batch.

    ``make`` runs once in a task; the function that it returns takes the
    batch's columns as Python lists and returns the output columns as lists.
    """
    small_batches(df.sparkSession)
    fields = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                out = f([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one process has a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
        base = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on texts of any length pass to Python in small pieces; a session that asks for less keeps its value."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def saved(df: DataFrame, name: str = "part", codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors. Texts go smaller as ``zstd``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # the table is whole once it is written: its shuffle files may go
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    _SAVED.append(path)
    return out


#: Paths of the tables that this process has saved and not deleted.
_SAVED: list[str] = []


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables saved since ``len(_SAVED)`` was ``since``; for when the results that read them are written."""
    for path in _SAVED[since:]:
        _delete(spark, path)
    del _SAVED[since:]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``saved`` that no later step reads."""
    path = getattr(df, "_tidewright_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _SAVED:
            _SAVED.remove(path)


# ------------------------------------------------------------------ hashing

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15) | _U(1)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (two xor-shift-multiply rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P^0..P^(n-1) modulo 2^64, or of the inverse of P; kept, and grown by doubling."""
    have = _POW.get(inverse)
    if have is None or len(have) < n:
        base = _U(pow(int(_P), -1, 1 << 64)) if inverse else _P
        have = _POW[inverse] = _powers(max(1 << 16, 1 << (n - 1).bit_length()), base)
    return have[:n]


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, with their start and end bytes.

    A polynomial hash over mixed bytes, from one cumulative sum; A-Z are lower-cased.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_SPACE[raw], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[_LOWER[raw] if lower else raw] * powers(len(raw)), out=total[1:])
    h = (total[end] - total[start]) * powers(len(raw), True)[start]
    return mix(h ^ mix((end - start).astype(np.uint64))), start, end


def doc_word_hashes(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of their words, offsets) by chunks of about CHUNK_BYTES."""
    at, n = 0, len(texts)
    while at < n:
        parts, total, to = [], 0, at
        while to < n and (total < CHUNK_BYTES or to == at):
            b = (texts[to] or "").encode("utf-8", "surrogatepass")
            parts.append(b)
            total += len(b) + 1
            to += 1
        h, start, _ = word_hashes(b"\n".join(parts))
        ends = np.cumsum([len(p) + 1 for p in parts])
        yield at, to, h, np.concatenate([[0], np.searchsorted(start, ends)])
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 100) -> np.ndarray:
    """Coefficients of a logistic model, the first column its constant, by Newton steps that are halved until the penalised likelihood rises.

    Whole steps can run away where the labels are nearly separated.
    """
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], float(ridge))
    penalty[0] = 1e-3

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0.0, z) - y * z).sum() + 0.5 * (penalty * b * b).sum())

    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        size = 1.0
        while size > 1e-6 and not loss(beta + size * step) < now:
            size /= 2
        if size <= 1e-6:
            break
        beta = beta + size * step
        before, now = now, loss(beta)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return beta
