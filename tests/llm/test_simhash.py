import re

import xxhash
from pyspark.sql import functions as F

from cohortlens.llm.components import connected_components
from cohortlens.llm.simhash import ball_links, hex_fingerprint, keep_one_per_group, simhash_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, links):
    lab = {f: f for f in fps}

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        lab[b] = a
    return {f: find(f) for f in fps}


def test_components_match_brute_force(awkward, clashing):
    rows = awkward.collect()
    fps = {fingerprint(r.text) for r in rows}
    comp = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    low = {}
    for r in rows:
        if r.doc_id is not None:
            k = comp[fingerprint(r.text)]
            low[k] = min(low.get(k, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{fingerprint(r.text):016x}", low.get(comp[fingerprint(r.text)])) for r in rows)
    for docs in (awkward, clashing):
        got = simhash_components(docs).select("doc_id", hex_fingerprint().alias("f"), "component_id").collect()
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == want


def test_odd_and_even_radius(spark):
    base = [0, 0b111, 0b1111, 0b11111111, (1 << 63) | 1, 1 << 63, 0x0F0F0F0F0F0F0F0F]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in base]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for d in (1, 2, 3, 4):
        want = components(base, [(a, b) for a in base for b in base if a < b and (a ^ b).bit_count() <= d])
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(ball_links(df, d)).collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
        assert {g for g in groups(want) if len(g) > 1} == groups(got)


def test_components_of_a_chain_and_a_star(spark):
    chain = spark.range(0, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1200).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.node: r.root for r in connected_components(chain.union(star).union(chain)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}, 5000: 1000}


def test_one_of_each_group_stays(awkward, clashing, empty):
    kept = keep_one_per_group(clashing)
    assert kept.columns == clashing.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    want = {str(r.component_id) for r in simhash_components(awkward).collect()}
    assert set(got) == want | ({"None"} if "None" in got else set()) and len(got) == len(set(got))
    assert keep_one_per_group(empty).count() == 0


def test_rows_of_one_id_or_none_are_kept_apart(spark):
    one, two, three = ("the first of three quite different texts here", "some other words that stand for themselves",
                       "a last line which nobody has copied so far")
    rows = [(1, one, "a"), (None, one.upper(), "b"), (None, two, "c"), (None, two, "c"),      # a copy without id
            (3, three, "d"), (5, three.title(), "e"), (5, two + " and then " + one, "f"),     # an id on two texts
            (7, three + " x y z " + two, "g"), (7, three + " x y z " + two, "g"), (7, three + " x y z " + two, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(1, one), (None, two), (3, three), (5, rows[6][1]), (7, rows[7][1])}
    for d in (docs, docs.repartition(7)):
        got = [(r.doc_id, r.text) for r in keep_one_per_group(d).collect()]
        assert len(got) == len(want) and set(got) == want
