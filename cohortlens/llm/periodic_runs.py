"""Periodic run detection by multi-scale minimizers.

A run is a stretch of words with smallest period q, of ``max(min_length,
min_repeats * q)`` words or more, that no neighbouring word extends. Texts are
turned into word codes and laid end to end, the longest first, with a code of
its own between any two, so that nothing repeats across texts.

Periods over ``SHORT`` go by scales, each a third wider than the one before. A
scale for periods in (low, high] hashes all stretches of ``high`` words and
keeps the window minima (minimizers) of ``2 * (low + 1) - high + 1`` places.
Inside a run of three periods one whole window and its place a period on hold
equal words, so the same place is a minimum in both; a stretch of ``high >= q``
words cannot occur again sooner than q, or the run would have a shorter period.
So the *next* equal minimizer lies exactly a period on, and pairs of neighbours
in the order (hash, place) seed every run. Shorter periods are seeded by
direct scans of each lag, at a stride that no run can slip through.

Seeds of one lag that overlap are one seed. It is extended to both sides by
binary search over prefix hashes; every stretch found is then compared word by
word, and a lag whose hashes have lied is scanned directly. A run whose period
is a multiple of a shorter one is dropped: the shorter lag finds it, too.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text; a text of any length is read whole, by one task; repeated rows
and repeated ids are treated row by row; an empty table gives an empty result;
of the input only the id and the text are read, so further columns of any name
do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import CHUNK_BYTES, Rolling, mix, start

SHORT = 16                  # periods up to this are found by direct lag scans
NO_RUNS = np.zeros((0, 3), np.int64)


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, window) for periods in (low, high], up to ``longest``."""
    low = SHORT
    while low < longest:
        high = -(-4 * low // 3)
        yield low, high, 2 * (low + 1) - high + 1
        low = high


def slide(op, a: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[:len(a) - (width - have)], a[width - have:]) if have < width else a


def minimizer_seeds(h: np.ndarray, low: int, high: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of neighbouring equal minimizers whose lag is of this scale."""
    none = np.zeros(0, np.int64)
    if len(h) < 2 * window:
        return none, none
    least = slide(np.minimum, h, window)
    # a place is a minimizer if some window over it has no smaller value
    best = h.copy()
    best[window - 1: len(h) - window + 1] = slide(np.maximum, least, window)
    best[:window - 1] = np.maximum.accumulate(least[:window - 1])
    best[len(h) - window + 1:] = np.maximum.accumulate(least[:-window:-1])[::-1]
    at = np.flatnonzero(best == h)
    at = at[np.argsort(h[at], kind="stable")]
    lag = at[1:] - at[:-1]
    pair = (h[at[1:]] == h[at[:-1]]) & (lag > low) & (lag <= high)
    return at[:-1][pair], lag[pair]


def stretch_ends(hashes: Rolling, at: np.ndarray, lag: np.ndarray, lo: np.ndarray, hi: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the words around ``at`` that equal those ``lag`` further on, within [lo, hi)."""
    def reach(most: np.ndarray, same) -> np.ndarray:
        least, most = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(least < most)
            if not len(open_):
                return least
            mid = (least[open_] + most[open_] + 1) // 2
            ok = same(open_, mid)
            least[open_[ok]] = mid[ok]
            most[open_[~ok]] = mid[~ok] - 1

    def equal(a, b, n):
        return hashes.range(a, a + n) == hashes.range(b, b + n)

    right = reach(hi - at - lag, lambda i, n: equal(at[i], at[i] + lag[i], n))
    left = reach(at - lo, lambda i, n: equal(at[i] - n, at[i] + lag[i] - n, n))
    return at - left, at + right


def has_period(x: np.ndarray, first: int, length: int, period: int) -> bool:
    return bool((x[first: first + length - period] == x[first + period: first + length]).all())


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] if n > 1 else out


def scan_lag(x: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, length) of all stretches of ``need`` words or more that repeat at ``lag``, word by word."""
    differ = np.flatnonzero(x[:-lag] != x[lag:])
    edge = np.concatenate([[-1], differ, [len(x) - lag]])
    found = np.flatnonzero(np.diff(edge) - 1 >= need - lag)
    return [(int(edge[i]) + 1, int(edge[i + 1] - edge[i] - 1) + lag) for i in found]


def find_runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int = 24, min_repeats: int = 3
              ) -> np.ndarray:
    """(start, length, period) of every run in the texts x[starts:ends], longest text first, by start and period.

    ``x`` has a code of its own after each text; ``min_repeats`` is at least 3.
    """
    if not len(starts) or ends[0] - starts[0] < min_length:
        return NO_RUNS
    sizes = ends - starts
    hashes = Rolling(mix(x.astype(np.uint64)))
    at, lag = [], []
    for q in range(1, min(SHORT, int(sizes[0]) // min_repeats) + 1):
        step = max(min_length, min_repeats * q) - q
        place = np.arange(0, len(x) - q, step)
        place = place[x[place] == x[place + q]]
        at.append(place)
        lag.append(np.full(len(place), q))
    for low, high, window in scales(int(sizes[0]) // min_repeats):
        n = int(np.searchsorted(-sizes, -max(min_length, min_repeats * (low + 1)), side="right"))
        if not n:
            break
        size = int(ends[n - 1])
        part = Rolling.__new__(Rolling)
        part.inv, part.sum = hashes.inv, hashes.sum[:size + 1]
        p, d = minimizer_seeds(part.every(high), low, high, window)
        at.append(p)
        lag.append(d)
    at, lag = np.concatenate(at), np.concatenate(lag)
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    # neighbours within a stretch that is known to repeat are one seed
    new = np.ones(len(at), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (lag[1:] <= SHORT) | (at[1:] - at[:-1] > lag[1:])
    at, lag = at[new], lag[new]
    doc = np.searchsorted(starts, at, side="right") - 1
    inside = at + lag < ends[doc]
    at, lag, doc = at[inside], lag[inside], doc[inside]
    first, end = stretch_ends(hashes, at, lag, starts[doc], ends[doc])
    length = end - first + lag
    long = length >= np.maximum(min_length, min_repeats * lag)
    found = np.unique(np.stack([first[long], length[long], lag[long]], axis=1), axis=0)
    out = []
    for s, n, q in found.tolist():
        if has_period(x, s, n, q):
            out.append((s, n, q))
        else:                       # hashes of unequal words were equal
            i = int(np.searchsorted(starts, s, side="right")) - 1
            own = x[starts[i]: ends[i]]
            out += [(int(starts[i]) + a, m, q) for a, m in scan_lag(own, q, max(min_length, min_repeats * q))]
    out = {(s, n, q) for s, n, q in out if not any(has_period(x, s, n, q // f) for f in _prime_factors(q))}
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def collapse_chunk(texts: list[bytes], min_length: int, min_repeats: int) -> list[tuple[np.ndarray, bytes]]:
    """(runs, collapsed text) of each text."""
    words = [t.split() for t in texts]                 # bytes.split() cuts at space and \x09-\x0D
    order = np.argsort([-len(w) for w in words], kind="stable")
    sizes = np.array([len(words[i]) for i in order], np.int64)
    codes = pa.array([w for i in order for w in words[i]], pa.large_binary()).dictionary_encode().indices.to_numpy()
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    between = np.zeros(len(x), bool)
    between[starts + sizes] = True
    x[between] = len(codes) + np.arange(len(sizes))
    x[~between] = codes
    runs = find_runs(x, starts, starts + sizes, min_length, min_repeats)
    cut = np.zeros(len(x) + 1, np.int64)
    np.add.at(cut, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cut, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(cut) == 0
    edge = np.searchsorted(runs[:, 0], np.append(starts, len(x)))
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        own = runs[edge[k]: edge[k + 1]] - [starts[k], 0, 0]
        w = words[i]
        if len(own):
            w = [w[j] for j in np.flatnonzero(kept[starts[k]: starts[k] + sizes[k]]).tolist()]
        out[i] = own, b" ".join(w)
    return out


def collapse_runs(docs: DataFrame, min_length: int = 24, min_repeats: int = 3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct<start, length, period>> by start and period, collapsed text) for every row.

    The collapsed text joins by one space the words that no run holds after its
    first period.
    """
    if min_repeats < 3:
        raise ValueError("minimizer pairs are sure to seed runs of three periods or more only")
    start(docs)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            group = np.cumsum(size) // CHUNK_BYTES
            for lo, hi in zip(np.flatnonzero(np.diff(group, prepend=-1)),
                              np.append(np.flatnonzero(np.diff(group)) + 1, len(group))):
                got = collapse_chunk([t or b"" for t in texts.slice(lo, hi - lo).to_pylist()], min_length, min_repeats)
                runs = np.concatenate([r for r, _ in got])
                edge = np.cumsum([0] + [len(r) for r, _ in got]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.ListArray.from_arrays(edge, items),
                     pa.array([c for _, c in got], pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    schema = f"id {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def most_repeated(runs: Column) -> Column:
    """The run of greatest length / period (compared exactly); ties: smallest start, then period. Null if none."""
    def before(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1)
                .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))
    return F.get(F.array_sort(runs, before), 0)


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every tenth text, by the checksum of its id, made periodic from some word on.

    With h = crc32(decimal id), g = h div 10, n words, h % 10 = 0 and n > 0: word i >= a becomes word
    a + (i - a) % p for a = g % n and p = 1 + (n - a) div (3 + g % 8). Other texts, and rows without an id,
    stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the words are split in the branch that needs them only
    picked = F.transform(
        F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))),
        lambda s: F.when(F.size(s["w"]) == 0, F.lit("")).otherwise(_periodic(s["w"], s["g"])))
    text = F.when((h % 10 == 0) & F.col(text_col).isNotNull(), F.get(picked, 0)).otherwise(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col), text.alias(text_col))


def _periodic(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    def word(i):
        return F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
