"""PII by candidate gradient boosting.

High-recall generators propose spans that may overlap. The four plain formats
(email, ip, card, phone) are always reported. Every other candidate is scored
by gradient-boosted trees over its format and its context, the scores are
calibrated by isotonic regression on a held-out fold, and candidates whose
calibrated probability reaches ``min_probability`` are added as spans.

Nobody labels the corpus, so the trees learn from weak labels that the
candidates give themselves: check digits, value ranges, words of the context
and the plain formats. Training takes at most ``train_rows`` of the labelled
candidates, chosen by a hash; every candidate is scored.

Positions are code points, end exclusive. Defined results: a null or empty
text has no spans; matches never cross texts; repeated rows are judged row by
row; with fewer than ``MIN_TRAIN`` labelled candidates of either label no
spans are added to the plain ones; of added candidates that overlap the more
probable one stays, among equal ones the longer, then the earlier kind, then
the earlier start; a text of any length is read whole, in time linear in it but
for sorting its spans; an empty table has no rows; of the input only the id and
the text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import chunks, stage, start

KINDS = ("email", "ip", "card", "phone", "written_email", "local_phone", "national_id", "iban", "ipv6", "long_number")
MIN_TRAIN = 30

# The plain formats (ASCII). Quantifiers that give nothing back keep long runs linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GENERATORS = (
    (4, re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}"
                   r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}){1,4}(?![A-Za-z0-9])")),
    (5, re.compile(r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    (6, re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    (7, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (8, re.compile(r"(?<![A-Za-z0-9:])(?:[0-9a-fA-F]{1,4}:){2,7}(?::?[0-9a-fA-F]{1,4}){1,7}(?![A-Za-z0-9:])")),
    (9, re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){10,18}(?![0-9])")),
)
CONTEXT = (
    re.compile(r"(?ai)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)\b"),
    re.compile(r"(?ai)\b(?:card|visa|mastercard|amex|credit|debit|payment|cvv)\b"),
    re.compile(r"(?ai)\b(?:ssn|social security|national id|passport|tax id|insurance)\b"),
    re.compile(r"(?ai)\b(?:iban|account|bank|swift|bic)\b"),
    re.compile(r"(?ai)\b(?:e-?mail|mail|contact|write|reach)\b"),
    re.compile(r"(?ai)\b(?:ip|host|server|address|login|client)\b"),
    re.compile(r"(?ai)\b(?:order|invoice|version|isbn|issn|serial|page|part|model|ticket|sku|lines?|total|chapter|no)\b"),
)
NEGATIVE = 6
FRIENDLY = {4: (4,), 5: (0,), 6: (2,), 7: (3,), 8: (5,), 9: (1, 3)}
ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "co"))


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of the plain formats; failing matches are candidates only."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        if m and s < at:
            out.append((0, s, m.end(), True))
            end = m.end()
            at = text.find("@", end)
        else:
            end = at                                       # nothing to the left can be part of a later one
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))
        out.append((1, m.start(), m.end(), ok))
    for m in CARD.finditer(text):
        n = digits_of(m.group())
        if len(n) >= 9:
            out.append((2, m.start(), m.end(), 16 <= len(n) <= 19 and luhn(n)))
    for m in PHONE.finditer(text):
        out.append((3, m.start(), m.end(), 8 <= len(digits_of(m.group())) <= 15))
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def weak_label(kind: int, s: str, around: list[bool], inside_base: bool) -> int:
    """1 or 0 by check digits, ranges and context; -1 if nothing speaks for either."""
    if inside_base:
        return 1
    if kind == 7:
        return int(iban_ok(s))
    if kind == 6:
        if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[-4:] == "0000":
            return 0
    if kind == 4 and ". " in s:
        return 0
    if kind == 9 and not luhn(digits_of(s)):
        return 0
    if around[NEGATIVE]:
        return 0
    if any(around[k] for k in FRIENDLY[kind]):
        return 1
    if kind == 4:                                          # a sentence end is no domain
        return int(". " not in s and re.split("[. ]", s)[-1] in ENDINGS)
    return -1


def features(text: str, kind: int, s: int, e: int) -> tuple[list[float], list[bool]]:
    """Format and context of a candidate; the second list says which context words are near."""
    span = text[s:e]
    before, after = text[max(0, s - 48): s], text[e: e + 16]
    around = [bool(p.search(before)) or bool(p.search(after)) for p in CONTEXT]
    num = digits_of(span)
    n = len(span)
    letters = sum(ch.isalpha() for ch in span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    seen: dict[str, int] = {}
    for ch in span:
        seen[ch] = seen.get(ch, 0) + 1
    bits = -sum(k / n * math.log2(k / n) for k in seen.values())
    window = before[-24:] + after
    values = [
        n, len(num), letters, n - len(num) - letters, len(num) / n, len(groups), max(groups), min(groups),
        span.count("-"), span.count("."), span.count(" "), span.count(":"), float("(" in span), float("+" in span),
        float("@" in span), bits, len(set(num)), float(len(num) >= 12 and luhn(num)),
        float(kind == 7 and iban_ok(span)),
        float(not before or not before[-1].isalnum()), float(not after or not after[0].isalnum()),
        float(before.endswith("\n") or not before), float(before.rstrip(" ").endswith((":", "=", "#"))),
        sum(ch.isdigit() for ch in window) / max(1, len(window)),
        sum(ch.isupper() for ch in window) / max(1, len(window)),
        float(num[:1] in "3456" if num else 0), float(num[:1] == "0"),
    ] + [float(x) for x in around] + [float(kind == k) for k in range(len(KINDS))]
    return [float(v) for v in values], around


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """(base spans, other candidates as (kind, start, end, label, features))."""
    every = base_matches(text)
    base = sorted((k, s, e) for k, s, e, ok in every if ok)
    spans = [(s, e) for _, s, e in base]
    out = []
    proposed = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e, ok in every if not ok]
    for kind, pattern in GENERATORS:
        proposed += [(kind, m.start(), m.end(), None) for m in pattern.finditer(text)]
    ends = sorted(spans)
    starts = np.array([s for s, _ in ends], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in ends], np.int64))    # how far the spans so far go
    for kind, s, e, passed in proposed:
        f, around = features(text, kind, s, e)
        if passed is not None:
            label = int(passed)
        else:
            i = int(np.searchsorted(starts, e)) - 1
            touching = i >= 0 and int(reach[i]) > s
            label = weak_label(kind, text[s:e], around, touching)
        out.append((kind, s, e, label, f))
    return base, out


_MARK = np.isin(np.arange(256), list(b"0123456789@[{("))
_AT = re.compile(rb"(?i) at ")
_HEX_OR_COLON = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF:"))


def suspects(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with a digit, an at sign, a bracket, a written "at", or a colon between hex digits or colons."""
    seen = np.zeros(len(b) + 1, np.int64)
    np.cumsum(_MARK[b], out=seen[1:])
    out = seen[off[1:]] > seen[off[:-1]]
    hits = np.array([m.start() for m in _AT.finditer(b.tobytes())], np.int64)
    colon = np.flatnonzero(b[1:-1] == 58) + 1
    hits = np.concatenate([hits, colon[_HEX_OR_COLON[b[colon - 1]] & _HEX_OR_COLON[b[colon + 1]]]])
    out[np.searchsorted(off, hits, side="right") - 1] = True
    return out


CAND = "array<struct<kind:int,s:int,e:int,label:int,f:array<double>>>"


def propose(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, base spans ("kind:start:end" list) and the other candidates."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    cand = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("label", pa.int32()),
                               ("f", pa.list_(pa.float64()))]))
    trip = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for rows, b, off in chunks(batch, "text"):
                n = rows.stop - rows.start
                base, more = [[]] * n, [[]] * n
                for i in np.flatnonzero(suspects(b, off)).tolist():
                    bs, cs = candidates(texts[rows.start + i].as_py())
                    base[i] = [{"kind": k, "s": s, "e": e} for k, s, e in bs]
                    more[i] = [dict(zip(("kind", "s", "e", "label", "f"), c)) for c in cs]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, n), pa.array(base, trip), pa.array(more, cand)], names=["id", "base", "cand"])

    return src.mapInArrow(run, f"id {id_type}, base array<struct<kind:int,s:int,e:int>>, cand {CAND}")


def score(cands: DataFrame, train_rows: int, seed: int) -> DataFrame | None:
    """``cands`` with a calibrated ``probability``; None without enough labels of both kinds."""
    seen = {r["label"]: r["n"] for r in cands.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3 rows
    if min(seen.get(0, 0), seen.get(1, 0)) < MIN_TRAIN:
        return None
    share = min(1.0, train_rows / (seen[0] + seen[1]))
    key = F.pmod(F.xxhash64("row", "s", "e", "kind", F.lit(seed)), F.lit(1 << 20))
    data = cands.where("label >= 0").withColumn("key", key).where(F.col("key") < share * (1 << 20))
    data = stage(data.select(F.col("label").cast("double").alias("label"), "f", "key"), "pii-train") \
        .withColumn("features", array_to_vector("f"))
    fold = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(5)) == 0
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=seed, maxBins=32).fit(data.where(~fold))
    margin = vector_to_array("rawPrediction")[1]
    held = model.transform(data.where(fold)).select("label", margin.alias("score"))
    shape = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="probability").fit(held)
    scored = model.transform(cands.where(F.col("kind") >= 4).withColumn("features", array_to_vector("f")))
    return shape.transform(scored.select("row", "kind", "s", "e", margin.alias("score")))


def free_spans(base: list[tuple[int, int, int]], added: list) -> list[tuple[int, int, int]]:
    """The added spans that touch no base span and no better added one; equal ones by length, kind and start."""
    taken = bytearray(max([e for _, _, e in base] + [x["e"] for x in added], default=0))
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    out = []
    for x in sorted(added, key=lambda x: (-x["p"], x["s"] - x["e"], x["kind"], x["s"])):
        if taken.find(1, x["s"], x["e"]) < 0:
            taken[x["s"]: x["e"]] = b"\1" * (x["e"] - x["s"])
            out.append((x["kind"], x["s"], x["e"]))
    return out


def join_spans(kinds_starts_ends) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in kinds_starts_ends)


def find_pii(docs: DataFrame, min_probability: float = 0.9, train_rows: int = 50_000, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) for every row."""
    start(docs)
    rows = stage(propose(docs, id_col, text_col), "pii-rows").withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "pii-candidates")
    cands = rows.where(F.size("cand") > 0).select("row", F.explode("cand").alias("c")).select("row", "c.*")
    scored = score(cands, train_rows, seed)
    added_type = "array<struct<p:double,kind:int,s:int,e:int>>"
    if scored is None:
        rows = rows.withColumn("added", F.lit(None).cast(added_type))
    else:
        added = (scored.where(F.col("probability") >= min_probability).groupBy("row")
                 .agg(F.collect_list(F.struct(F.col("probability").alias("p"), "kind", "s", "e")).alias("added")))
        rows = rows.join(added, "row", "left")
    id_type = rows.schema["id"].dataType.simpleString()

    def finish(batches):
        for batch in batches:
            n = [[] for _ in range(5)]
            digest, spans = [], []
            for base, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = [(x["kind"], x["s"], x["e"]) for x in base]
                more = free_spans(base, added or [])
                for k in range(4):
                    n[k].append(sum(b[0] == k for b in base))
                n[4].append(len(more))
                digest.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                spans.append(join_spans(base + sorted(more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in n], pa.array(digest, pa.string()),
                 pa.array(spans, pa.string())],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    return (rows.select("id", "base", "added")
            .mapInArrow(finish, f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, n_added long, "
                                "base_sha256 string, spans string").withColumnRenamed("id", id_col))
