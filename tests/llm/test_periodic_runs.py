import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cohortlens.llm import periodic_runs as P, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(x, min_length=24, repeats=3):
    n, out = len(x), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(min_length, repeats * q) and not any(
                    x[i:i + size - d] == x[i + d:i + size] for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(x, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(x) if i not in gone]


def random_text(rnd, words):
    n = rnd.choice([0, 1, 23, 24, 60, 120, 300, words])
    x = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 20, 1000]))}" for _ in range(n)]
    for _ in range(rnd.randint(0, 3) if n > 30 else 0):
        q, a = rnd.randint(1, n // 3), rnd.randrange(n)
        for i in range(a + q, min(n, a + rnd.randint(q, n))):
            x[i] = x[i - q]
    return x


def test_random_texts_match_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        docs = [random_text(rnd, 400) for _ in range(rnd.randint(1, 6))]
        for x, (runs, text) in zip(docs, P.collapse_chunk([" ".join(x).encode() for x in docs], 24, 3)):
            want = brute_runs(x)
            assert [tuple(r) for r in runs.tolist()] == want
            assert text.decode() == " ".join(collapse(x, want))


def test_self_similar_texts():
    a, b = "0", "01"
    while len(b) < 700:
        a, b = b, b + a
    thue_morse = [str(bin(i).count("1") % 2) for i in range(1024)]       # no cube, and equal hashes of unequal words
    for x in (list(b[:700]), thue_morse, ["a"] * 500, list("abaab") * 90):
        got = P.collapse_chunk([" ".join(x).encode()], 24, 3)[0][0]
        assert [tuple(r) for r in got.tolist()] == brute_runs(x)


@pytest.mark.parametrize("period", [16, 17, 22, 23, 40, 41, 333])
def test_edges_of_the_scales(period):
    rnd = random.Random(period)
    x = [f"a{i}" for i in range(50)] + [f"p{rnd.random()}" for _ in range(period)] * 3 + [f"z{i}" for i in range(50)]
    for cut, want in ((0, [(50, 3 * period, period)]), (1, [])):
        y = x[:50 + 3 * period - cut] + x[50 + 3 * period:]
        got = P.collapse_chunk([" ".join(y).encode()], 24, 3)[0][0]
        assert [tuple(r) for r in got.tolist()] == want


def test_hashes_that_lie_are_found_out(monkeypatch):
    """With all words of equal hash every seed is wrong, and the direct scan of its lag puts it right."""
    monkeypatch.setattr(P, "mix", lambda x: np.ones_like(x))
    x = [f"w{i}" for i in range(40)] + ["a", "b", "c"] * 12 + [f"v{i}" for i in range(40)]
    got = P.collapse_chunk([" ".join(x).encode()], 24, 3)[0][0]
    assert (40, 36, 3) in [tuple(r) for r in got.tolist()] and all(x[s + i] == x[s + i + q] for s, n, q in got.tolist()
                                                                   for i in range(n - q))


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(collapse(words, runs))))


def test_query_matches_brute_force(spark, tmp_path, clashing):
    rnd = random.Random(9)
    rows = [(i, " ".join(random_text(rnd, 200)) if i % 3 else rnd.choice(["\n", "\t \x0b", "  "]).join(random_text(rnd, 150)))
            for i in range(120)]
    own = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    short = clashing.where("length(text) < 5000 or text is null")
    for name, docs in (("a", own), ("b", short)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.op13_periodic_runs(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        want = sorted(map(str, (contract(r.doc_id, r.text) for r in docs.collect())))
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert any(r[1] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in (contract(*r) for r in rows))


def test_long_text_and_empty_table(spark, empty, awkward):
    assert P.collapse_runs(empty).count() == 0
    row = P.collapse_runs(awkward.where("doc_id = 56")).first()           # 400 equal lines
    period = row.runs[0].period
    assert len(row.runs) == 1 and row.runs[0].start == 0 and len(WORD.findall(row.collapsed)) == period
    with pytest.raises(ValueError):
        P.collapse_runs(awkward, min_repeats=2)
