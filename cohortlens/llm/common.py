"""Shared helpers: reading tables, byte views of texts, rolling hashes, stages.

Byte helpers work on one *chunk*: the UTF-8 bytes of several whole texts laid
end to end, with the offset of each text. Chunks hold a few MB, so the
temporary arrays of a task stay bounded; one longer text is a chunk by itself.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.session import ship_package, stage_root

CHUNK_BYTES = 1 << 20

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def start(df: DataFrame) -> SparkSession:
    """The frame's session, with the package on the Python workers."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; ``session.drop_stages`` removes them all."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage).

    ``release``: have the driver collect its garbage, so that Spark's cleaner
    drops the shuffle files of the finished stage now and not some time later.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    if release:
        release_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark's cleaner drops the shuffle files of what is done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stage(*stages: DataFrame) -> None:
    """Remove the files of stages that nothing reads any more."""
    for df in stages:
        stages_dropper(df.sparkSession)(df.stage_path)


def stages_dropper(spark: SparkSession):
    """``drop(path)`` for stage folders that are no longer read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def drop(path: str) -> None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return drop


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


COPY_RUN = 65_536           # equal rows that one task makes anew at a time


def numbered_copies(rows: DataFrame, copy_run: int = COPY_RUN) -> DataFrame:
    """``rows`` with ``copy``: equal rows are counted, and made anew with numbers from 0.

    Hashed with the rest of a row, the number spreads repeated rows like any
    others, and it does not depend on how the input is cut. Counting adds up
    within the tasks first; many copies are made in runs, so that no task makes
    them all. For narrow rows: every column is part of the key.
    """
    key = rows.columns
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    first = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(copy_run).cast("long"))
    runs = counted.select("*", F.explode(first).alias("_at")).repartition(*key, "_at")
    return runs.select(*key, F.explode(F.sequence("_at", F.least(F.col("_n"), F.col("_at") + copy_run) - 1)).alias("copy"))


# ---- chunks ---------------------------------------------------------------

def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    arr = arr.cast(pa.large_binary())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset: arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, col: str, limit: int = CHUNK_BYTES
           ) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    raw, off = buffers(batch.column(batch.schema.get_field_index(col)))
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield slice(i, j), raw[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def is_word_byte(b: np.ndarray) -> np.ndarray:
    """True where the byte is not one of space and \\x09-\\x0D."""
    return ~((b == 32) | ((b - np.uint8(9)) < 5))


def word_bounds(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of word bytes within a text."""
    w = is_word_byte(b)
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = off[(off > 0) & (off < len(b))]
    first[cut] = w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cut - 1] = w[cut - 1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, np.searchsorted(off, ws, side="right") - 1


def per_text(doc: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    """Sum of integer ``values`` (or the count) per text."""
    if values is None:
        return np.bincount(doc, minlength=n).astype(np.int64)
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return c[edge[1:]] - c[edge[:-1]]


# ---- rolling hashes (mod 2^64) ---------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * _M1
    x = x ^ (x >> U64(33))
    x = x * _M2
    return x ^ (x >> U64(33))


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Rolling:
    """Polynomial prefix hash: the hash of any range of ``values`` in O(1)."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        have = self._pow.get(base)
        if have is None or len(have[0]) < n + 1:
            size = max(n + 1, 1 << 16)
            inv = pow(base, -1, 1 << 64)
            have = (self._powers(base, size), self._powers(inv, size))
            if size <= 4 * CHUNK_BYTES:
                self._pow[base] = have
        self.inv = have[1]
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values * have[0][:n], out=self.sum[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        p = np.full(n, U64(base))
        p[0] = 1
        return np.cumprod(p)

    def range(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of values[lo:hi], mixed with its length."""
        h = (self.sum[hi] - self.sum[lo]) * self.inv[lo]
        return mix(h + (hi - lo).astype(np.uint64) * _M2)

    def every(self, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` values, as ``range`` gives them."""
        n = len(self.sum) - width
        return mix((self.sum[width:] - self.sum[:-width]) * self.inv[:n]
                   + U64(width * int(_M2) % (1 << 64)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, found earlier) for each key, in input order."""
    n = len(keys)
    twice, again = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        eq = s[1:] == s[:-1]
        again[order[1:][eq]] = True
        twice[order[1:][eq]] = True
        twice[order[:-1][eq]] = True
    return twice, again
