"""Quality rules by repetition coverage.

Words, n-gram windows and lines are hashed with rolling hashes in numpy, and
the characters inside duplicated n-grams (several lengths) and duplicated
lines are measured per text. A text is rejected when too large a part of its
characters lies inside repetition, when it is too short, or when symbols make
up too much of it.

Defined results: a null or empty text has no words and fails the length rule;
repeated rows are judged row by row; every other column of the input is left
alone, and only the id column is carried along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import (Rolling, U64, byte_table, chunks, mix, per_text, repeated,
                                   start, word_bounds)


@dataclass(frozen=True)
class RepetitionRules:
    """Limits. Coverages are shares of the characters in words."""

    min_words: int = 50
    max_repeat_word_share: float = 0.50        # words in 3-word windows found twice or more
    # characters inside n-grams found twice or more (first included), by n
    max_ngram_share: dict[int, float] = field(default_factory=lambda: {
        4: 0.45, 5: 0.40, 6: 0.36, 8: 0.32, 10: 0.30})
    max_dup_line_share: float = 0.30           # characters in lines equal to an earlier line
    max_symbols_per_word: float = 0.25         # characters of ``SYMBOLS`` for each word


SYMBOLS = b"#*$%&|<>"
_TABLE = byte_table(7)
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
BASE_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def measure_chunk(b: np.ndarray, off: np.ndarray, ngrams: list[int]) -> dict[str, np.ndarray]:
    """Counts for each text of a chunk; ``cover_n``: characters inside repeated n-grams."""
    n = len(off) - 1
    ws, we, doc = word_bounds(b, off)
    cp = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=cp[1:])
    chars = cp[we] - cp[ws]
    bytes_hash = Rolling(_TABLE[b])
    words = Rolling(bytes_hash.range(ws, we))
    salt = mix(np.arange(n, dtype=np.uint64) + U64(1))
    out = {"n_words": per_text(doc, None, n), "word_chars": per_text(doc, chars, n)}
    sym = np.zeros(len(b) + 1, np.int64)
    np.cumsum(_IS_SYMBOL[b], out=sym[1:])
    out["n_symbols"] = sym[off[1:]] - sym[off[:-1]]

    def covered(k: int) -> np.ndarray:
        j = np.arange(max(0, len(ws) - k + 1))
        j = j[doc[j] == doc[j + k - 1]]
        twice, _ = repeated(mix(words.range(j, j + k) ^ salt[doc[j]]))
        step = np.zeros(len(ws) + 1, np.int64)
        step[j[twice]] += 1
        step[j[twice] + k] -= 1
        return np.cumsum(step[:-1]) > 0

    for k in sorted({3, *ngrams}):
        inside = covered(k)
        if k == 3:
            out["n_repeat_words"] = per_text(doc, inside, n)
        if k in ngrams:
            out[f"cover_{k}"] = per_text(doc, chars * inside, n)

    # lines: split at \n and at text ends; only lines with a word count
    nl = np.flatnonzero(b == 10)
    edges = np.unique(np.concatenate([off, nl + 1]))
    lo, hi = edges[:-1], edges[1:].copy()
    hi -= (b[hi - 1] == 10) if len(hi) else 0
    first_word, end_word = np.searchsorted(ws, lo), np.searchsorted(ws, hi)
    full = end_word > first_word
    lo, hi, first_word, end_word = lo[full], hi[full], first_word[full], end_word[full]
    line_doc = np.searchsorted(off, lo, side="right") - 1
    _, again = repeated(mix(bytes_hash.range(lo, hi) ^ salt[line_doc]))
    cw = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(chars, out=cw[1:])
    out["n_dup_lines"] = per_text(line_doc, again, n)
    out["dup_line_chars"] = per_text(line_doc, (cw[end_word] - cw[first_word]) * again, n)
    return out


def repetition_metrics(docs: DataFrame, rules: RepetitionRules = RepetitionRules(),
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per input row: the id, base counts and ``cover_n`` columns."""
    start(docs)
    ngrams = sorted(rules.max_ngram_share)
    names = BASE_FIELDS + [f"cover_{k}" for k in ngrams]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for rows, b, off in chunks(batch, "text"):
                m = measure_chunk(b, off, ngrams)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, rows.stop - rows.start)] + [pa.array(m[c]) for c in names],
                    names=["id", *names])

    return (src.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{c} long" for c in names))
            .withColumnRenamed("id", id_col))


def judged(metrics: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the counts."""
    c = F.col
    base = (c("n_words") < rules.min_words) | (
        100 * c("n_repeat_words") > int(100 * rules.max_repeat_word_share) * c("n_words"))
    bad = c("dup_line_chars") > rules.max_dup_line_share * c("word_chars")
    bad = bad | (c("n_symbols") > rules.max_symbols_per_word * c("n_words"))
    for k, share in sorted(rules.max_ngram_share.items()):
        bad = bad | (c(f"cover_{k}") > share * c("word_chars"))
    return metrics.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def quality_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """doc_id, counts, coverages, ``base_failed`` and ``kept`` for every row of ``docs``."""
    return judged(repetition_metrics(docs, rules), rules)


def keep_passing(docs: DataFrame, rules: RepetitionRules = RepetitionRules(),
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged (no shuffle, no join)."""
    start(docs)
    ngrams = sorted(rules.max_ngram_share)

    @F.arrow_udf("boolean")
    def passes(text: pa.Array) -> pa.Array:
        batch, out = pa.RecordBatch.from_arrays([text], names=["t"]), []
        for _, b, off in chunks(batch, "t"):
            m = measure_chunk(b, off, ngrams)
            ok = (m["n_words"] >= rules.min_words) & (
                100 * m["n_repeat_words"] <= int(100 * rules.max_repeat_word_share) * m["n_words"])
            ok &= m["dup_line_chars"] <= rules.max_dup_line_share * m["word_chars"]
            ok &= m["n_symbols"] <= rules.max_symbols_per_word * m["n_words"]
            for k in ngrams:
                ok &= m[f"cover_{k}"] <= rules.max_ngram_share[k] * m["word_chars"]
            out.append(ok)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(passes(F.col(text_col).cast("string")))
