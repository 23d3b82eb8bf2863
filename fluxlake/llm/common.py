"""Shared helpers: checkpoint folder, bounded Arrow batches, byte-level word arrays, crc32 folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 500_000
#: Bytes of a batch on its way to a worker; a longer row goes alone.
ARROW_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one of our own, but on a single machine only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", "")
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.conf.get("fluxlake.shared.dir", "")
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="fluxlake-")
        spark.conf.set("fluxlake.shared.dir", own)
    return own


def bounded(spark: SparkSession) -> None:
    """From here on batches that go to workers hold ARROW_BYTES at most, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def release() -> None:
    """Gives memory that a task no longer holds back to the machine: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded size, by workers that keep nothing between tasks."""
    bounded(df.sparkSession)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(clean, schema)


def slices(batch: pa.RecordBatch, column: int, rows: int = 1000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: so many rows and bytes of text at most; a longer text is a part of its own."""
    offsets = _offsets(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """Like materialise, as a table in buckets by key: joins on the key read it without a shuffle. df should be partitioned by the key already."""
    spark = df.sparkSession
    name = f"fluxlake_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._written_at, out._table = path, name
    return out


def discard(*written: DataFrame) -> None:
    """Deletes what materialise, bucketed or components wrote, once nothing reads it any more."""
    for df in written:
        spark = df.sparkSession
        if getattr(df, "_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df._table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ASCII_LOWER = _BYTE.copy()
_ASCII_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_PRIME, _INVERSE)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts and where each text starts in them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(off, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def steps(texts: pa.Array):
    """(first row, last row, bytes, offsets) of runs of at most STEP_BYTES; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    raw, offsets = _offsets(texts)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts: byte spans, and first[i]:first[i+1] as the words of text i."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        space = _SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hashes of the words, with A-Z as a-z if asked."""
        up, down = _power_tables(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((_ASCII_LOWER if lower else _BYTE)[self.raw] * up[: len(self.raw)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * _PLACE[j]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int = 5):
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one, none make an empty set."""
    for a, b, raw, offsets in steps(texts):
        w = Words(raw, offsets)
        h = w.hashes()
        all_k = windows(h, k)
        for i in range(b - a):
            s, e = w.first[i], w.first[i + 1]
            if e - s >= k:
                yield np.unique(all_k[s : e - k + 1])
            elif e > s:
                yield windows(np.concatenate([h[s:e], np.zeros(0, np.uint64)]), int(e - s)) ^ np.uint64(e - s)
            else:
                yield np.zeros(0, np.uint64)
