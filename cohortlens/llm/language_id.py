"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is folded to lower-case letters and single spaces, and its n-grams of 1
to ``max_n`` characters are hashed into ``2 ** bits`` buckets. Training counts
the buckets of each language over all rows it is given: a task adds its texts
up, Spark sums the tasks' counts by language and bucket, and each language's
smoothed log probabilities become one array. The model is a matrix of buckets x
languages; both are bounded (``bits``, ``MAX_LANGUAGES``), so it is broadcast.
Texts are scored in batches: the bucket numbers of a batch are its sparse rows,
the matrix gives their log probabilities, and sums over a text's range, plus
the language's log share of training rows, give the class scores.

``score`` is the posterior probability of the language chosen.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text where no language was learned; equal posteriors go to the
language that is first by code point; a text of any length is read whole, by
one task; repeated rows and ids are scored row by row, and each row with a language is a training
row; rows without an id are not learned from and not held out; an empty table
gives an empty result; further columns of any name are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import U64, chunks, mix, start

MAX_LANGUAGES = 128         # columns of the broadcast matrix: 64 MB at 17 bits
HELD_LANGUAGES = 16         # count arrays that a task holds before it sends them
UNKNOWN = "und"
_TABLES: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, space for everything else."""
    if not _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _TABLES.append(table)
    return _TABLES[0]


def folded(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of the texts of a chunk; each text begins and ends with a space."""
    lead = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=lead[1:])
    edge = lead[off]
    cp = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    sym = _fold_table()[cp]
    n = len(edge) - 1
    # a space in front of and behind each text, then one of each run of spaces
    out = np.full(len(sym) + 2 * n, 32, np.uint32)
    at = np.arange(len(sym)) + 2 * np.repeat(np.arange(n), np.diff(edge)) + 1
    out[at] = sym
    edge = edge + 2 * np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[edge[:-1]] = True
    new = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=new[1:])
    return out[keep], new[edge]


def grams(sym: np.ndarray, max_n: int, bits: int) -> list[np.ndarray]:
    """Bucket of the n-gram that begins at each symbol, for n = 1..max_n (the last n - 1 symbols begin none)."""
    out, h = [], np.zeros(len(sym), np.uint64)
    value = mix(sym.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    for n in range(1, max_n + 1):
        if len(sym) < n:
            break
        h = h[:len(sym) - n + 1] * U64(0x9E3779B97F4A7C15) + value[n - 1:]
        out.append((mix(h + U64(n)) >> U64(64 - bits)).astype(np.int64))
    return out


def text_grams(b: np.ndarray, off: np.ndarray, max_n: int, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(buckets, offsets by text) for each n], letters by text)."""
    sym, edge = folded(b, off)
    letters = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(sym != 32, out=letters[1:])
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    out = []
    for n, g in enumerate(grams(sym, max_n, bits), 1):
        own = doc[:len(g)] == doc[n - 1:]               # within one text
        out.append((g[own], np.searchsorted(doc[:len(g)][own], np.arange(len(edge)))))
    return out, letters[edge[1:]] - letters[edge[:-1]]


@dataclass(frozen=True)
class LanguageModel:
    """log_probs[bucket, language]; languages by code point; log_priors by language."""

    languages: list[str]
    log_probs: np.ndarray
    log_priors: np.ndarray
    max_n: int
    bits: int


def count_buckets(texts: DataFrame, max_n: int, bits: int) -> DataFrame:
    """(lang, bucket, c) over (lang, text): the sum of what the tasks have counted."""
    def run(batches):
        held: dict[str, np.ndarray] = {}

        def sent():
            for lang, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                                  pa.array(c[at])], names=["lang", "bucket", "c"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for rows, b, off in chunks(batch, "text"):
                names = langs[rows]
                for lang in dict.fromkeys(names.tolist()):
                    pick = np.flatnonzero(names == lang)
                    own = np.concatenate([b[off[i]: off[i + 1]] for i in pick])
                    edge = np.append(0, np.cumsum(np.diff(off)[pick]))
                    if lang not in held:
                        if len(held) == HELD_LANGUAGES:
                            yield from sent()
                        held[lang] = np.zeros(1 << bits, np.int64)
                    for g, _ in text_grams(own, edge, max_n, bits)[0]:
                        held[lang] += np.bincount(g, minlength=1 << bits)
        yield from sent()

    return (texts.mapInArrow(run, "lang string, bucket int, c long")
            .groupBy("lang", "bucket").agg(F.sum("c").alias("c")))


def train(texts: DataFrame, max_n: int = 4, bits: int = 17, smoothing: float = 0.5) -> LanguageModel:
    """The model of all rows (lang, text) with both present; a row per language reaches the driver."""
    start(texts)
    texts = texts.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang is not null and text is not null")
    rows = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: the model would outgrow its broadcast")
    width = 1 << bits

    def log_array(key, table):
        c = np.full(width, smoothing)
        c[table.column("bucket").to_numpy()] += table.column("c").to_numpy()
        return pa.table({"lang": [key[0].as_py()], "logs": [np.log(c / c.sum()).astype("<f4").tobytes()]})

    logs = {r.lang: np.frombuffer(bytes(r.logs), "<f4") for r in count_buckets(texts, max_n, bits)
            .groupBy("lang").applyInArrow(log_array, "lang string, logs binary").collect()}
    names = sorted(logs)                                 # code-point order
    total = sum(rows[x] for x in names)
    return LanguageModel(names, np.stack([logs[x] for x in names], axis=1) if names else np.zeros((width, 0), "f4"),
                         np.array([np.log(rows[x] / total) for x in names]), max_n, bits)


def score_chunk(b: np.ndarray, off: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language or -1, posterior) of each text."""
    parts, letters = text_grams(b, off, model.max_n, model.bits)
    n = len(off) - 1
    if not model.languages:
        return np.full(n, -1), np.zeros(n)
    sums = np.tile(model.log_priors, (n, 1))
    for g, edge in parts:
        have = np.flatnonzero(edge[1:] > edge[:-1])
        if len(have):
            for k in range(len(model.languages)):
                sums[have, k] += np.add.reduceat(model.log_probs[:, k][g], edge[:-1][have], dtype=np.float64)
    best = sums.argmax(axis=1)                           # the first of equal ones
    score = 1.0 / np.exp(sums - sums[np.arange(n), best][:, None]).sum(axis=1)
    best[letters == 0] = -1
    score[letters == 0] = 0.0
    return best, score


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``."""
    spark = start(docs)
    shared = spark.sparkContext.broadcast(
        LanguageModel(model.languages, np.asfortranarray(model.log_probs), model.log_priors, model.max_n, model.bits))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        names = np.array(model.languages + [UNKNOWN], object)        # -1 is the last
        for batch in batches:
            ids = batch.column(0)
            for rows, b, off in chunks(batch, "text"):
                best, score = score_chunk(b, off, model)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, rows.stop - rows.start), pa.array(names[best], pa.string()), pa.array(score)],
                    names=["id", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; null without an id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def identify(docs: DataFrame, max_n: int = 4, bits: int = 17, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learned from the rows whose fold is not 1, predicted for all."""
    known = docs.where(fold(id_col) != 1).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    out = predict(docs, train(known, max_n, bits), id_col, text_col)
    return out.select(id_col, F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
