"""Secret scans by assignment-aware lexing.

Three plain formats (keyword assignment, access key, long hex run) are always
reported. Beside them, texts with assignment syntax are lexed into names,
literals and operators; name-literal pairs are read from source code and from
configuration syntax (``name = "x"``, ``name: Optional[str] = 'x'``, ``"name": "x"``,
``NAME=x``, ``name: x``, ``call(name="x")``, ``name = b"x"``, ``name = ("x")``,
``names = ["x", "y"]``, ``name = call("key", "x")``), constants are propagated through
names, ``+`` and adjacent literals, over line breaks after ``+``, a backslash or
inside brackets, and each literal is scored by the names it reaches, its own
shape and signs of a placeholder. Literals that score high enough become
``literal`` spans.

Positions are code points, end exclusive. Defined results: a null or empty
text has no spans; matches never cross texts; repeated rows are scanned row by
row; a quote that is not closed on its line is plain text; a call's first
argument is a key or a prompt, the literals after it are values; a text of any
length is read whole, in time linear in its length but for sorting; an empty
table has no rows; of the input only the id and the text are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import chunks, start

# The three formats, as ASCII patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "literal")

MIN_SCORE = 3.0

TOKEN = re.compile(
    r"""(?P<quote>["'`])"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|->|[=:+,;(){}\[\]])"""
    r"""|(?P<nl>\n)"""
    r"""|(?P<other>[^\s"'`=:+,;(){}\[\]]+)""")
QUOTE = re.compile("[\"'`]")
STRING_PREFIX = {"b", "r", "f", "u", "br", "rb", "fr", "rf"}
PAIRS = {"(": ")", "[": "]", "{": "}"}

# Parts of a name and their weight for a literal assigned to it.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "pass": 2.0, "secret": 3.0, "token": 2.5,
    "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "bearer": 2.5, "private": 1.0,
    "access": 1.0, "key": 1.0, "client": 0.5, "signing": 1.0, "encryption": 1.0, "session": 0.5, "salt": 1.5,
    "cookie": 1.0, "api": 1.0, "webhook": 1.0, "dsn": 1.5, "jwt": 2.5, "pat": 1.0,
}
# Parts that say the literal is about a secret, not the secret.
HARMLESS = {"file", "path", "url", "uri", "name", "type", "length", "len", "size", "count", "max", "min", "id",
            "expiry", "expires", "ttl", "hint", "label", "field", "prefix", "suffix", "env", "header", "limit",
            "public", "example", "policy", "regex", "pattern", "format"}
PLACEHOLDER = re.compile(r"(?ai:change_?me|example|placeholder|your[_-]|dummy|sample|redacted|xxx+|\*\*\*+|todo|none|null|true|false|undefined|test$)"
                         r"|^\$\{|^\$[A-Z_]+$|^<|^%[sd(]|\{\{")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How much a target name speaks of a secret."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    if parts and parts[-1] in HARMLESS:
        return 0.0
    best = sum(SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in set(parts))
    return min(best, 3.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret by itself (may be negative)."""
    if len(value) < 6 or PLACEHOLDER.search(value):
        return -9.0
    if re.search(r"\s", value):
        return -1.5
    n = len(value)
    counts: dict[str, int] = {}
    for ch in value:
        counts[ch] = counts.get(ch, 0) + 1
    bits = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return (bits >= 2.5) * 0.5 + (bits >= 3.5) * 0.5 + (kinds >= 2) * 0.5 + (n >= 16) * 0.5


def closing_quotes(text: str) -> dict[int, int]:
    """Opening quote -> closing quote of the same kind on the same line, for every quote that could open.

    A quote closes if an even number of backslashes stands before it (a back
    quote always does), wherever the literal began; so all are found once, from
    the end of the text.
    """
    out: dict[int, int] = {}
    nearest: dict[str, int] = {}
    breaks = [m.start() for m in re.finditer("\n", text)]
    for m in reversed(list(QUOTE.finditer(text))):
        i, q = m.start(), m.group()
        if breaks and breaks[-1] > i:                    # another line
            nearest = {}
            while breaks and breaks[-1] > i:
                breaks.pop()
        if q in nearest:
            out[i] = nearest[q]
        k = i
        while q != "`" and k and text[k - 1] == "\\":
            k -= 1
        if (i - k) % 2 == 0:
            nearest[q] = i
    return out


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): quoted literals are ``str``; a quote that does not close is ``other``."""
    closing, out, free = closing_quotes(text), [], 0
    for m in TOKEN.finditer(text):
        s = m.start()
        if s < free:
            continue                                     # inside a literal
        kind, e = m.lastgroup, m.end()
        if kind == "quote":
            kind, e = ("str", closing[s] + 1) if s in closing else ("other", e)
            free = e
        out.append((kind, s, e))
    return out


class _Reader:
    """Right-hand sides over the tokens of one text; every bracket's own elements are read once."""

    def __init__(self, text: str):
        self.text, self.toks = text, tokens(text)
        self.words = [text[s:e] if k != "str" else "" for k, s, e in self.toks]
        n = len(self.toks)
        self.match: dict[int, int] = {}                  # opening bracket -> closing one
        held: list[int] = []
        for i, w in enumerate(self.words):
            if w in PAIRS:
                held.append(i)
            elif w in (")", "]", "}") and held and PAIRS[self.words[held[-1]]] == w:
                self.match[held.pop()] = i
        # a bare word runs on to the next blank or separator
        self.run = list(range(n))
        for i in range(n - 2, -1, -1):
            if self.toks[i + 1][1] == self.toks[i][2] and self.toks[i + 1][0] in ("name", "other", "op") \
                    and self.words[i + 1] not in (",", ";", "(", ")", "{", "}", "[", "]"):
                self.run[i] = self.run[i + 1]

    def word(self, i: int) -> str:
        return self.words[i] if i < len(self.words) else ""

    def over_breaks(self, i: int, inside: bool) -> int:
        """The next token behind line breaks that do not end the expression."""
        while i < len(self.toks):
            if self.toks[i][0] == "nl" and inside:
                i += 1
            elif self.word(i) == "\\" and self.word(i + 1) == "\n":
                i += 2
            else:
                break
        return i

    def operand(self, i: int, bound: dict[str, int], found: dict, bare: bool) -> int | None:
        """Add what the operand at ``i`` is bound to; the place behind it, or None if there is none."""
        if i >= len(self.toks):
            return None
        kind, s, e = self.toks[i]
        word = self.words[i]
        if kind == "name" and i + 1 < len(self.toks) and self.toks[i + 1][0] == "str" and self.toks[i + 1][1] == e \
                and word.lower() in STRING_PREFIX:
            i += 1
            kind, s, e = self.toks[i]
        if kind == "str":
            if e - s > 2:
                found[(s + 1, e - 1)] = None
            return i + 1
        if word in ("(", "[") and i in self.match:
            self.elements(i, bound, found, call=False)
            return self.match[i] + 1
        if kind == "name" and word in bound:
            found[bound[word]] = None
            return i + 1
        if kind == "name" and self.word(i + 1) == "(" and i + 1 in self.match:
            self.elements(i + 1, bound, found, call=True)
            return self.match[i + 1] + 1
        if kind in ("name", "other") and bare:
            stop = self.run[i]
            if self.word(stop + 1) != "(":               # a call, not a literal
                found[(s, self.toks[stop][2])] = None
            return stop + 1
        return None

    def elements(self, i: int, bound: dict[str, int], found: dict, call: bool) -> None:
        """The literals and known names inside the bracket at ``i``, lists in lists included; of a call, those after the first.

        Brackets of calls, of tables and of other targets are passed over: each is read by its owner only.
        """
        end, k, nth = self.match[i], i + 1, 0
        while k < end:
            kind, word = self.toks[k][0], self.words[k]
            if word == ",":
                nth += 1
            if k in self.match:
                plain = word in ("(", "[") and not call and self.word(k - 1) in ("", ",", "(", "[", "+", "\n")
                k = k + 1 if plain else self.match[k] + 1
            elif kind == "str" or (kind == "name" and self.word(k + 1) != "(" and (word in bound or word.lower() in STRING_PREFIX)):
                k = self.operand(k, bound, {} if call and not nth else found, False) or k + 1
            else:
                k += 1

    def value(self, k: int, bound: dict[str, int]) -> list[tuple[int, int] | int]:
        """What the right-hand side from token ``k`` on is bound to."""
        found: dict[tuple[int, int] | int, None] = {}   # in order, each once
        bare = True
        k = self.over_breaks(k, False)
        while (after := self.operand(k, bound, found, bare)) is not None:
            bare = False
            k = self.over_breaks(after, False)
            if self.word(k) == "+":
                k = self.over_breaks(k + 1, True)
            elif not (k < len(self.toks) and self.toks[k][0] == "str" and self.toks[after - 1][0] == "str"):
                break                                    # neither a sum nor adjacent literals
        return list(found)


def bindings(text: str) -> list[tuple[str, list[tuple[int, int] | int]]]:
    """(target name, what it is bound to) in order: spans of literals, and numbers of earlier bindings.

    A name on the right-hand side stands for the binding that it had last in
    this text. It is listed by number and once, so the list stays as short as
    the text however often constants are doubled or handed on.
    """
    r = _Reader(text)
    out: list[tuple[str, list[tuple[int, int] | int]]] = []
    bound: dict[str, int] = {}
    for i, (kind, s, e) in enumerate(r.toks):
        if kind not in ("name", "str"):
            continue
        j = i + 1
        if r.word(j) == "]":                             # table["name"] = ...
            j += 1
        sign = r.word(j)
        if sign not in ("=", ":", ":=", "=>"):
            continue
        k = j + 1
        if sign == ":" and k < len(r.toks) and r.toks[k][0] == "name":
            # name: type = ..., name: type[of, these] = ...
            behind = r.match[k + 1] + 1 if r.word(k + 1) == "[" and k + 1 in r.match else k + 1
            if r.word(behind) == "=":
                k = behind + 1
        found = r.value(k, bound)
        if found:
            target = text[s:e] if kind == "name" else text[s + 1: e - 1]
            bound[target] = len(out)
            out.append((target, found))
        # the right-hand side may itself hold a target (a = b = "x", {"a": {"b": "x"}})
    return out


def literal_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int]]:
    every = bindings(text)
    reach = [name_score(name) for name, _ in every]      # the best name that a binding reaches
    best: dict[tuple[int, int], float] = {}
    for i in range(len(every) - 1, -1, -1):              # bindings only name earlier ones
        if reach[i] <= 0:
            continue
        for x in every[i][1]:
            if isinstance(x, int):
                reach[x] = max(reach[x], reach[i])
            else:
                best[x] = max(best.get(x, 0.0), reach[i])
    found = []
    for (s, e), by_name in best.items():
        shape = literal_score(text[s:e])
        if text[s - 1: s] not in ('"', "'", "`") and shape < 1.0:
            continue                                     # a bare word must look like a key by itself
        if by_name + shape >= min_score:
            found.append((s, e))
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three plain formats."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def join_spans(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


def suspects(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that can hold a span at all: an assignment sign, AKIA or 24 hex digits in a row."""
    n = len(off) - 1
    hit = [np.flatnonzero((b == 61) | (b == 58))]
    run = np.zeros(len(b) + 1, np.int64)
    np.cumsum(_HEX[b], out=run[1:])
    if len(b) >= 24:
        hit.append(np.flatnonzero(run[24:] - run[:-24] == 24))
    raw, at = b.tobytes(), -1
    while (at := raw.find(b"AKIA", at + 1)) >= 0:
        hit.append(np.array([at]))
    out = np.zeros(n, bool)
    for h in hit:
        out[np.searchsorted(off, h, side="right") - 1] = True
    return out


_NONE = hashlib.sha256(b"").hexdigest()


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one text as (start, kind number, end)."""
    base = base_spans(text)
    return base, sorted(base + [(s, 3, e) for s, e in literal_spans(text)])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_literal, base_sha256, spans) for every row."""
    start(docs)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    fields = ["n_assign", "n_access", "n_hex", "n_literal"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for rows, b, off in chunks(batch, "text"):
                n = rows.stop - rows.start
                counts = np.zeros((4, n), np.int64)
                digest, spans = [_NONE] * n, [""] * n
                for i in np.flatnonzero(suspects(b, off)).tolist():
                    base, every = scan(texts[rows.start + i].as_py())
                    for _, k, _ in every:
                        counts[k, i] += 1
                    digest[i] = hashlib.sha256(join_spans(base, KINDS).encode()).hexdigest()
                    spans[i] = join_spans(every, KINDS)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, n), *map(pa.array, counts), pa.array(digest), pa.array(spans)],
                    names=["id", *fields, "base_sha256", "spans"])

    return (src.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{c} long" for c in fields)
                           + ", base_sha256 string, spans string").withColumnRenamed("id", id_col))


def mask(text: str, spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    """``text`` with every span replaced by <KIND>; overlapping spans become one."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        s, k, e = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][2])
            i += 1
        out += [text[at:s], f"<{kinds[k].upper()}>"]
        at = e
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets masked in the text; texts without any, and nulls, are unchanged."""
    start(docs)

    @F.arrow_udf("string")
    def masked(text: pa.Array) -> pa.Array:
        batch, out = pa.RecordBatch.from_arrays([text], names=["t"]), []
        for rows, b, off in chunks(batch, "t"):
            part = text.slice(rows.start, rows.stop - rows.start)
            hit = np.flatnonzero(suspects(b, off)).tolist()
            if hit:
                values = part.to_pylist()
                for i in hit:
                    _, every = scan(values[i])
                    if every:
                        values[i] = mask(values[i], every)
                part = pa.array(values, pa.string())
            out.append(part.cast(pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
