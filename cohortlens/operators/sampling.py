"""Exact-size reproducible simple random sample (without replacement).

Every row gets a 60-bit key from md5(key | seed); the sample is the
floor(fraction * n) rows with the smallest (key, id).  Finding that cut
uses a 2^20-bucket histogram of the key's top bits (an aggregate, so a
bounded table), then orders only the rows of the one bucket that holds the
cut.  No global sort, no single task holding the sample, and the returned
DataFrame is a plain filter of the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.schema import ID

BUCKET_SHIFT = 40  # 60-bit key -> 2^20 buckets


def sample_key(key: str, seed: int):
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 15), 16, 10)
    return h.cast("bigint")


_MD5_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).tolist()
_MD5_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_MD5_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_head(words: list) -> np.ndarray:
    """The first eight bytes, as a big-endian number, of the md5 of one block of 16 words each (arrays, or numbers that all rows share)."""
    a, b, c, d = _MD5_START
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + a + (words[g] + _MD5_ADD[i])
            s = _MD5_TURNS[i]
            a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
        a, b = (np.asarray(v + w, np.uint32).byteswap().astype(np.uint64) for v, w in zip((a, b), _MD5_START))
    return (a << np.uint64(32)) | b


def sample_keys(raw: np.ndarray, off: np.ndarray, seeds: Sequence[int]) -> np.ndarray:
    """seeds x rows: what ``sample_key`` gives, for keys as text (bytes of all, offsets)."""
    out = np.empty((len(seeds), len(off) - 1), np.int64)
    size = np.diff(off)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        if n > 40:                      # more than a block with the seed
            for i, seed in enumerate(seeds):
                out[i, rows] = [int(hashlib.md5(raw[off[r]:off[r + 1]].tobytes() + b"|%d" % seed).hexdigest()[:15], 16) for r in rows]
            continue
        text = np.zeros((len(rows), 64), np.uint8)
        text[:, :n] = raw[off[rows][:, None] + np.arange(n)]
        varies = -(-n // 4)             # words that hold bytes of the key
        own = np.ascontiguousarray(text.view("<u4")[:, :varies].T)
        for i, seed in enumerate(seeds):
            tail = b"|%d" % seed
            block = np.zeros(64, np.uint8)
            block[n:n + len(tail) + 1] = np.frombuffer(tail + b"\x80", np.uint8)
            block[56:] = np.frombuffer((8 * (n + len(tail))).to_bytes(8, "little"), np.uint8)
            fixed = block.view("<u4")
            out[i, rows] = (_md5_head([own[w] | fixed[w] if w < varies else fixed[w] for w in range(16)]) >> np.uint64(4)).view(np.int64)
    return out


def exact_sample(df: DataFrame, fraction: float, seed: int, key: str = ID) -> DataFrame:
    n = df.count()
    k = math.floor(fraction * n)
    keyed = df.withColumn("_sk", sample_key(key, seed)).withColumn("_sb", F.shiftright("_sk", BUCKET_SHIFT))
    if k <= 0:
        return df.limit(0)
    if k >= n:
        return df
    hist = keyed.groupBy("_sb").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_sb").rowsBetween(Window.unboundedPreceding, 0)
    # At most 2^20 histogram rows: a bounded single-partition running sum.
    cut = (hist.withColumn("_hi", F.sum("_n").over(w)).withColumn("_lo", F.col("_hi") - F.col("_n"))
           .where((F.col("_lo") < k) & (F.col("_hi") >= k)).first())
    b, need = cut["_sb"], k - cut["_lo"]
    last = (keyed.where(F.col("_sb") == b).orderBy("_sk", key).select("_sk", key)
            .limit(need).orderBy(F.col("_sk").desc(), F.col(key).desc()).first())
    tk, tid = last["_sk"], last[key]
    inside = (F.col("_sb") < b) | ((F.col("_sb") == b) & (
        (F.col("_sk") < tk) | ((F.col("_sk") == tk) & (F.col(key) <= tid))))
    return keyed.where(inside).drop("_sk", "_sb")


def sample_key_sql(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 15) AS BIGINT)"
