"""What the operators of this folder share: the cluster's scratch folder, words, hashes of words and token ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Whitespace that separates words: blank and the control characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster that is an error, as executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodequarry-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{scratch_root(spark)}/lodequarry/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


# Rows and bytes that Spark hands to Python at a time while an operator writes.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, Python gets small Arrow batches: both ends of the pipe hold one in memory, beside the whole heap."""
    before = {k: spark.conf.get(k, None) for k in _BATCH}
    for k, v in _BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there and any executor may be lost."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64's finaliser)."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64 (base is odd, so that the inverse exists)."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_TABLE = np.ones(256, bool)
_TABLE[[0x20, 9, 10, 11, 12, 13]] = False
_BASE = 0x5851F42D4C957F2D
_POW = powers(1 << 16)
_INV = powers(1 << 16, pow(_BASE, -1, 1 << 64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.take(_TABLE, buf, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial in its bytes, scrambled. Equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    size = 1 << 15  # so that a span begins and ends in a window of the power table unless it is itself that long
    at = 0
    while at < len(starts):
        origin = starts[at]
        to = int(np.searchsorted(ends, origin + len(_POW), "right"))
        if to == at:  # one very long word
            b = buf[origin : ends[at]].astype(np.uint64) + np.uint64(1)
            h = np.zeros(1, np.uint64)  # arrays wrap around silently
            for k in range(0, len(b), size):
                part = b[k : k + size]
                h = h * _POW[len(part)] + (part * _POW[: len(part)][::-1]).sum(dtype=np.uint64)
            out[at] = (h * np.uint64(_BASE) + np.uint64(len(b)))[0]
            at += 1
            continue
        end = int(ends[to - 1])
        b = buf[origin:end].astype(np.uint64) + np.uint64(1)
        # reversed powers: the value of a span is sum byte * base**(end-1-i), as for the long word
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * _INV[: len(b)], out=total[1:], dtype=np.uint64)
        s, e = starts[at:to] - origin, ends[at:to] - origin
        h = (total[e] - total[s]) * _POW[e - 1]
        out[at:to] = h * np.uint64(_BASE) + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def flat_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column behind one another, each followed by a newline, and where each begins.

    Null counts as empty. The newline keeps the words of neighbours apart."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.offset or column.null_count:
        column = pa.array([x or "" for x in column.to_pylist()], pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    n = len(column)
    begin = off[:-1] - off[0] + np.arange(n)
    buf = np.full(len(raw) + n, 10, np.uint8)
    lens = np.diff(off)
    keep = np.ones(len(buf), bool)
    keep[begin + lens] = False
    buf[keep] = raw
    return buf, np.append(begin, len(buf))


#: What a Python worker keeps between tasks and can do without: called to drop it.
HELD: list[Callable[[], None]] = []
try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library
    _trim = None


def release(held: bool = False) -> None:
    """Give memory that is free back to the system, and with `held` also what other operators have remembered: workers live on, and share an executor's memory with its heap."""
    import pyarrow as pa

    for drop in HELD if held else ():
        drop()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch, limit: int = 4 << 20, column: str = "text"):
    """Parts of a record batch that hold about `limit` bytes of text at most, or one row."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    if len(size) and size[-1] > limit // 4:
        release()
