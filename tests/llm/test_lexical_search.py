import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import lexical_search as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """[(item id, rank, doc id, score)] over [(id, text)] lists."""
    docs = [(i, collections.Counter(terms(t))) for i, t in docs]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        got = []
        for doc, c, n in docs:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                got.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, g[3], -g[0]) for r, g in enumerate(sorted(got, key=lambda g: g[:3])[:k], 1)]
    return out


def ranked(df):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=key)


def check(docs, items, k, **sizes):
    index = X.build_index(docs, slice_terms=sizes.get("slice_terms", X.SLICE_TERMS))
    got = X.search(index, items, k, block_terms=sizes.get("block_terms", X.BLOCK_TERMS))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert ranked(got) == sorted(want, key=key)
    return want


ITEMS = [(1, "thtiing oned EN tail"), (2, "the of"), (3, None), (4, "..."), (5, "Grüße 日本 one"), (6, "nowhere at all"),
         (1, "thtiing oned EN tail"), (None, "two"), (7, "x " * 500 + "w3")]


@pytest.mark.parametrize("sizes", [{}, {"slice_terms": 60, "block_terms": 4}])
def test_ranks_match_brute_force(spark, awkward, clashing, sizes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert check(awkward, items, 5, **sizes)
    check(clashing, items.select("*", F.lit(1).alias("item"), F.lit(2).alias("rank"), F.lit("x").alias("doc")), 50, **sizes)


def test_ties_take_the_smallest_ids(spark):
    """A third of all rows are copies: equal scores over many slices of one stratum."""
    rows = [(i, "alpha beta gamma") for i in range(200, 0, -1)] + [(1000 + i, f"alpha w{i} x{i % 7} " + "y " * (i % 23))
                                                                   for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "beta gamma"), (2, "alpha"), (3, "x3 y alpha beta")], "item_id long, text string")
    want = check(docs, items, 50, slice_terms=90)
    assert [d for i, _, d, _ in want if i == 1] == list(range(1, 51))


def test_strata_below_the_floor_are_left_out(spark):
    """The floor of the first visits spares the long strata, and the result stays whole."""
    rows = [(i, "rare " * (1 + i % 3) + "pad " * (i * 3)) for i in range(1, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, spark.createDataFrame([(1, "rare")], "item_id long, text string"), 10)


def test_empty_tables(spark, empty, awkward):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert X.search(X.build_index(empty), items).count() == 0
    assert X.search(X.build_index(awkward), none).count() == 0
