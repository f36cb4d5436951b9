"""SentencePiece (BPE) encoding with seeded merge-dropout, and decoding.

The vocabulary file gives the pieces and merge priorities. A text is encoded
by the usual agenda: take the best candidate merge (leftmost on ties), unless
a keyed hash of (seed, row id, copy, segment and its place, position, merged
piece) says to skip it. Skipping a merge leads to another segmentation of the same characters, so
decoding gives the text back exactly whatever was skipped.

No piece spans a change from text to blanks, so texts fall into independent
segments (a run of blanks and the word behind it). What a segment becomes
without skips, and the merges that lead there, are kept for each distinct one;
every occurrence has a key of its own, and the agenda is run again for those
that skip one of these merges. It runs in numpy for many segments at once, one
merge per segment and round; segments of over ``LONG`` characters use a heap.

Defined results: a null text has null ids; an empty text has no ids; repeated
rows get equal ids unless they are numbered as copies; characters outside the vocabulary, and U+2581 itself, are
written as byte pieces, so every text decodes losslessly.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cohortlens.llm.common import Rolling, U64, chunks, mix, start

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
ESCAPED = 0x110000          # stands for a U+2581 of the text itself
LONG = 48
CACHE_SEGMENTS = 400_000
NONE = np.int64(1) << np.int64(62)
MASK64 = (1 << 64) - 1


def _mix1(x: int) -> int:
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK64
    return x ^ (x >> 33)


class Pieces:
    """Tables of one vocabulary file."""

    def __init__(self, model_bytes: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
        self.n, self.byte0 = n, sp.piece_to_id("<0x00>")
        ids = {t: i for i, t in enumerate(text) if normal[i]}
        # merge priority: higher score first
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        self.rank = np.zeros(n, np.int64)
        self.char_id = np.full(ESCAPED + 1, -1, np.int32)
        self.joins = np.zeros(ESCAPED + 1, bool)     # characters that some longer piece holds
        pair: dict[int, int] = {}
        for t, i in ids.items():
            self.rank[i] = order[sp.get_score(i)]
            if len(t) == 1:
                self.char_id[ord(t)] = i
                continue
            self.joins[[ord(c) for c in t]] = True
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    pair[a * n + b] = i
        if any("▁" in t.lstrip("▁") for t in ids):
            raise ValueError("pieces with inner blanks are not supported")
        self.joins &= self.char_id >= 0
        self.pair = pair
        # the same pairs as an open-addressing table for whole arrays
        keys, ids_ = np.array(list(pair), np.int64), np.array(list(pair.values()), np.int32)
        self.shift = U64(64 - max(10, int(len(keys) * 8).bit_length()))
        self.slot_key = np.full((1 << (64 - int(self.shift))) + 64, -1, np.int64)
        self.slot_id = np.full(len(self.slot_key), -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            first = np.unique(at, return_index=True)[1]
            first = first[self.slot_key[at[first]] < 0]
            self.slot_key[at[first]], self.slot_id[at[first]] = keys[first], ids_[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids_, at = keys[rest], ids_[rest], at[rest] + 1
        # bytes of each piece for decoding (blank as a space)
        raw = [bytes([i - self.byte0]) if sp.is_byte(i) else (t.replace("▁", " ").encode() if normal[i] else b"")
               for i, t in enumerate(text)]
        self.length = np.array([len(r) for r in raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two adjacent pieces make, or -1."""
        key = left.astype(np.int64) * self.n + right
        at = self._slot(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_id[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.slot_key[at[open_]]
            same = found == key[open_]
            out[open_[same]] = self.slot_id[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)


@lru_cache(maxsize=2)
def _pieces(model_bytes: bytes) -> Pieces:
    return Pieces(model_bytes)


def skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, limit: int) -> np.ndarray:
    """Keyed hash of a candidate merge: True if it is to be skipped."""
    x = mix(key ^ mix(place.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + piece.astype(np.uint64)))
    return (x >> U64(11)) < U64(limit)


def skipped1(key: int, place: int, piece: int, limit: int) -> bool:
    return _mix1(key ^ _mix1((place * 0x9E3779B97F4A7C15 + piece) & MASK64)) >> 11 < limit


def merge_one(p: Pieces, ids: list[int], key: int, limit: int, log: list | None = None) -> list[int]:
    """The agenda for one segment with a heap: (priority, place) first, skipped merges dropped.

    ``log`` takes the (place, piece) of each merge.
    """
    n = len(ids)
    ids, right, left = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i < 0 or j >= n:
            return
        new = p.pair.get(ids[i] * p.n + ids[j])
        if new is not None:
            heapq.heappush(heap, (int(p.rank[new]), i, new, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j >= n or ids[j] != b or skipped1(key, i, new, limit):
            continue
        if log is not None:
            log.append((i, new))
        ids[i], ids[j] = new, -1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [x for x in ids if x >= 0]


def merge_all(p: Pieces, sym: np.ndarray, seg: np.ndarray, keys: np.ndarray, limit: int,
              log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The agenda for many segments, one merge per segment and round.

    ``sym``: character pieces, ``seg``: their segment (ascending); returns the
    final pieces and their segments. ``log`` takes (segments, places, pieces)
    of the merges of each round.
    """
    count = np.bincount(seg)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)

    def candidates(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Priority and piece of the pairs (i, i + 1)."""
        new = p.merged(sym[i], sym[i + 1])
        new[seg[i] != seg[i + 1]] = -1
        live = np.flatnonzero(new >= 0)
        live = live[skipped(keys[seg[i[live]]], place[i[live]], new[live], limit)]
        new[live] = -1
        return np.where(new >= 0, (p.rank[new] << 16) + place[i], NONE), new

    out_sym, out_seg = [], []
    prio = np.full(len(sym), NONE)
    made = np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        prio[:-1], made[:-1] = candidates(np.arange(len(sym) - 1))
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        best = np.minimum.reduceat(prio, first)
        count = np.diff(np.append(first, len(seg)))
        active = np.repeat(best < NONE, count)
        if not active.all():                               # finished segments leave
            out_sym.append(sym[~active])
            out_seg.append(seg[~active])
            sym, seg, place, prio, made = (x[active] for x in (sym, seg, place, prio, made))
            best, count = best[best < NONE], count[best < NONE]
            if not len(sym):
                break
        hit = np.flatnonzero(prio == np.repeat(best, count))   # one per segment: places differ
        if log is not None:
            log.append((seg[hit], place[hit], made[hit]))
        sym[hit] = made[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        hit = hit - np.arange(len(hit))                        # positions after the removal
        sym, seg, place, prio, made = (x[keep] for x in (sym, seg, place, prio, made))
        prio[hit], made[hit] = NONE, -1
        fresh = np.concatenate([hit - 1, hit])
        fresh = fresh[(fresh >= 0) & (fresh < len(sym) - 1)]
        prio[fresh], made[fresh] = candidates(fresh)
    if not out_sym:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sym, seg = np.concatenate(out_sym), np.concatenate(out_seg)
    order = np.argsort(seg, kind="stable")
    return sym[order], seg[order]


class Encoder:
    """Encodes chunks of texts; keeps the segments it has met (forgotten when there are many)."""

    def __init__(self, p: Pieces, seed: int, dropout: float, variants: int | None = None):
        """``variants`` is taken for older callers only: every occurrence has a key of its own."""
        self.p = p
        self.limit = int(dropout * (1 << 53))
        self.seed = mix(np.array([seed + 1], np.uint64))[0]
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(0, np.uint64)       # sorted
        self.check = np.zeros(0, np.uint64)
        self.lo = np.zeros(0, np.int64)         # tokens without skips
        self.n = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)         # the merges that lead there
        self.merges = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.piece = np.zeros(0, np.int32)

    def encode(self, b: np.ndarray, off: np.ndarray, row_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets) of the texts of a chunk."""
        texts = len(off) - 1
        lead = np.zeros(len(b) + 1, np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=lead[1:])
        cps = lead[off]
        cp = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        cp = np.where(cp == BLANK, ESCAPED, np.where(cp == 32, BLANK, cp))
        full = np.flatnonzero(np.diff(cps) > 0)
        cp = np.insert(cp, cps[full], BLANK)                   # the leading blank of every text
        edge = cps + np.concatenate([[0], np.cumsum(np.diff(cps) > 0)])
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        blank, alone = cp == BLANK, ~self.p.joins[cp]
        cut = np.ones(len(cp), bool)
        cut[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        cut[edge[:-1][np.diff(edge) > 0]] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], len(cp))
        doc = np.searchsorted(edge, lo, side="right") - 1
        each = np.bincount(doc, minlength=texts)
        nth = np.arange(len(lo)) - np.repeat(np.cumsum(each) - each, each)
        values = mix(cp.astype(np.uint64) + U64(1))
        h = Rolling(values).range(lo, hi)
        check = Rolling(values, 0xD6E8FEB86659FD93 | 1).range(lo, hi)
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.key) > CACHE_SEGMENTS:
            self.forget()
        at = np.searchsorted(self.key, uniq)
        at[at == len(self.key)] = 0
        known = (self.key[at] == uniq) & (self.check[at] == check[where]) if len(self.key) else np.zeros(len(uniq), bool)
        self._learn(uniq[~known], check[where[~known]], cp, lo[where[~known]], hi[where[~known]])
        at = np.searchsorted(self.key, uniq)
        n, src = self.n[at][back], self.lo[at][back]
        tokens = self.tokens
        if self.limit:
            key = mix(h ^ mix(row_key[doc] ^ mix(nth.astype(np.uint64) ^ self.seed)))
            # the agenda goes another way only where one of the merges without skips is skipped
            m = self.merges[at][back]
            ends = np.cumsum(m)
            flat = np.arange(int(ends[-1])) + np.repeat(self.at[at][back] - (ends - m), m)
            owner = np.repeat(np.arange(len(lo)), m)
            off_way = owner[skipped(key[owner], self.place[flat], self.piece[flat], self.limit)]
            again = off_way[np.concatenate([[True], off_way[1:] != off_way[:-1]])] if len(off_way) else off_way
            if len(again):
                got, begin, count, _ = self._merge(key[again], cp, lo[again], hi[again], self.limit)
                src[again], n[again] = begin + len(tokens), count
                tokens = np.concatenate([tokens, got])
        stop = np.cumsum(n)
        total = int(stop[-1])
        flat = tokens[np.arange(total) + np.repeat(src - (stop - n), n)]
        per_doc = np.searchsorted(doc, np.arange(texts + 1))
        return flat, np.concatenate([[0], stop])[per_doc]

    def _merge(self, key: np.ndarray, cp: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: int, logged: bool = False
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """(tokens, begin, count, (segment, place, piece) of the merges) of the segments cp[lo:hi]."""
        p, size = self.p, hi - lo
        short = np.flatnonzero(size <= LONG)
        n = size[short]
        seg = np.repeat(np.arange(len(short)), n)
        pos = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        char = cp[lo[short][seg] + pos]
        sym = p.char_id[char]
        other = sym < 0                                        # single characters without a piece
        log: list = []
        got, owner = merge_all(p, np.where(other, p.n, sym).astype(np.int32), seg, key[short], limit,
                               log if logged else None)
        tokens: list[np.ndarray] = []
        made = np.bincount(owner, minlength=len(short))
        if other.any():
            bytes_of = {int(s): list(chr(BLANK if c == ESCAPED else c).encode("utf-8"))
                        for s, c in zip(seg[other].tolist(), char[other].tolist())}
            parts, at = [], 0
            ends = np.cumsum(made)
            for s in sorted(bytes_of):
                stop = int(ends[s]) - int(made[s])
                parts += [got[at:stop], np.array([p.byte0 + x for x in bytes_of[s]], np.int32)]
                at = int(ends[s])
            got = np.concatenate(parts + [got[at:]])
            for s, raw in bytes_of.items():
                made[s] = len(raw)
        tokens.append(got)
        count = np.zeros(len(key), np.int64)
        begin = np.zeros(len(key), np.int64)
        count[short] = made
        begin[short] = np.cumsum(made) - made
        total = len(got)
        log = [(short[s], at, new) for s, at, new in log]
        for s in np.flatnonzero(size > LONG).tolist():
            steps: list = []
            ids = merge_one(p, p.char_id[cp[lo[s]: hi[s]]].tolist(), int(key[s]), limit, steps if logged else None)
            begin[s], count[s] = total, len(ids)
            total += len(ids)
            tokens.append(np.array(ids, np.int32))
            if steps:
                at, new = np.array(steps, np.int64).T
                log.append((np.full(len(steps), s), at, new.astype(np.int32)))
        merges = tuple(np.concatenate(x) for x in zip(*log)) if log else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        return np.concatenate(tokens), begin, count, merges

    def _learn(self, key: np.ndarray, check: np.ndarray, cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if not len(key):
            return
        got, begin, count, (seg, place, piece) = self._merge(key, cp, lo, hi, 0, True)
        order = np.argsort(seg, kind="stable")
        merges = np.bincount(seg, minlength=len(key))
        at = np.cumsum(merges) - merges + len(self.place)
        self.place = np.concatenate([self.place, place[order]])
        self.piece = np.concatenate([self.piece, piece[order]])
        begin += len(self.tokens)
        self.tokens = np.concatenate([self.tokens, got])
        # a key met again with another check value replaces the old entry
        old = ~np.isin(self.key, key)
        order = np.argsort(np.concatenate([self.key[old], key]), kind="stable")
        self.key = np.concatenate([self.key[old], key])[order]
        self.check = np.concatenate([self.check[old], check])[order]
        self.lo = np.concatenate([self.lo[old], begin])[order]
        self.n = np.concatenate([self.n[old], count])[order]
        self.at = np.concatenate([self.at[old], at])[order]
        self.merges = np.concatenate([self.merges[old], merges])[order]


def decode_flat(p: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that the pieces stand for; the leading blank is dropped."""
    n = p.length[ids]
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(ids) else 0
    raw = p.bytes[np.arange(total) + np.repeat(p.at[ids] - (stop - n), n)]
    at = np.concatenate([[0], stop])[off]
    have = np.diff(at) > 0
    raw = np.delete(raw, at[:-1][have])
    return raw, at - np.concatenate([[0], np.cumsum(have)])


def _model(path: str) -> bytes:
    with open(path, "rb") as f:                # read on the driver, sent with the task (0.5 MB)
        return f.read()


def _row_keys(ids: pa.Array) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return mix(ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64))
    import xxhash
    return np.array([xxhash.xxh64_intdigest(str(x)) for x in ids.to_pylist()], np.uint64)


def encode_documents(docs: DataFrame, seed: int = 0, dropout: float = 0.1,
                     model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
                     copies: bool = False) -> DataFrame:
    """(id, ids, n_tokens, n_bytes, lossless) for every row; ``lossless``: the ids decode to the text.

    ``copies``: rows of equal id and text are numbered, and each number skips merges of its own.
    """
    start(docs)
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))   # a fixed file of 0.5 MB
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    nth = F.row_number().over(Window.partitionBy("id", F.xxhash64("text")).orderBy("id")) - 1
    src = src.withColumn("copy", (nth if copies else F.lit(0)).cast("long"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        p = _pieces(model.value)
        enc = Encoder(p, seed, dropout)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            null = text.is_null().to_numpy(zero_copy_only=False)
            for rows, b, off in chunks(batch, "text"):
                keys = ids.slice(rows.start, rows.stop - rows.start)
                copy = batch.column(2).to_numpy()[rows].astype(np.uint64)
                flat, at = enc.encode(b, off, _row_keys(keys) ^ mix(copy))
                raw, stops = decode_flat(p, flat, at)
                same = np.diff(stops) == np.diff(off)
                if same.all():
                    differ = np.concatenate([[0], np.cumsum(raw != b)])
                    same = differ[off[1:]] == differ[off[:-1]]
                gone = null[rows]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(gone, False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [keys, lists, pa.array(np.diff(at), mask=gone), pa.array(np.diff(off), mask=gone), pa.array(same)],
                    names=["id", "ids", "n_tokens", "n_bytes", "lossless"])

    return (src.mapInArrow(run, f"id {id_type}, ids array<int>, n_tokens long, n_bytes long, lossless boolean")
            .withColumnRenamed("id", id_col))


def decode_documents(tokens: DataFrame, model_path: str = MODEL, ids_col: str = "ids",
                     text_col: str = "text") -> DataFrame:
    """Add ``text_col``: the text of ``ids_col`` (null for null)."""
    start(tokens)
    model = tokens.sparkSession.sparkContext.broadcast(_model(model_path))

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        p = _pieces(model.value)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null([]) if ids.null_count else ids
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        raw, off = decode_flat(p, flat, np.concatenate([[0], np.cumsum(n)]))
        data = raw.tobytes()
        return pa.array([None if z else data[s:e].decode("utf-8")
                         for z, s, e in zip(null, off[:-1].tolist(), off[1:].tolist())], pa.string())

    return tokens.withColumn(text_col, decoded(F.col(ids_col)))
