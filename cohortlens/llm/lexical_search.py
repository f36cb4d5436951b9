"""Ranked lexical search over a length-stratified index.

A document's length enters its score through the normaliser m only, an integer,
so the documents of equal m form a *stratum* and share one impact for each term
frequency. The index holds, for every slice of a stratum, its documents in the
order of their ids and its postings by term and frequency; a stratum is cut
into as many slices as its terms need (``SLICE_TERMS`` each), so no slice grows
with the corpus.

Searching goes through the strata in the order of their bounds. For an item, a
stratum's bound is the sum over the item's terms of weight x impact at the
largest frequency of the term in that stratum. The first visits are the best
strata that are sure to hold ``k`` matches; their k-th best score is a floor.
The other strata are visited only where their bound reaches the floor. A slice
visited computes weight x impact once for each (term, frequency), whatever the
number of documents or items, adds it up by document and hands over its ``k``
best for each item. Nothing is cut but what k better documents beat.

Items are taken in blocks of bounded size (``BLOCK_TERMS`` distinct terms in
all); a block's terms are what is broadcast.

Scores are integers: m = base + (slope * n * N) div L, with N documents that
hold a term, L terms in all, n terms of the document; a term in df documents
weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); tf occurrences at m score
w * ((10^9 tf) div (1000 tf + 20 m)).

Defined results: a null text, or one without a term, is no document and no
item with results; an item asks for each of its terms once; equal scores rank
by ascending document id, rows without one last; rows that share a document id,
and repeated rows, are documents of their own and each take a rank; repeated
items are answered one by one; a text of any length is indexed whole, in one
slice; empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import drop_stage, stage, start

SLICE_TERMS = 250_000       # occurrences of terms in one slice of a stratum
BLOCK_TERMS = 200_000       # distinct terms of the items that are searched at once
BASE, SLOPE = 50, 50        # of the normaliser: 50 at no length, 100 at the mean length
_TERM = bytearray(b" " * 256)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _TERM[_c] = _c
for _c in range(0x41, 0x5B):
    _TERM[_c] = _c + 32
_TERM = bytes(_TERM)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and anything beyond ASCII."""
    return text.translate(_TERM).split()


def term_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) for every row with a term; n counts occurrences."""
    start(rows)
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for lo in range(0, len(ids), 256):
                rows, n, sizes, names, tfs = [], [], [0], [], []
                for i, text in enumerate(texts.slice(lo, 256).to_pylist()):
                    c = Counter(terms_of(text))
                    if c:
                        rows.append(lo + i)
                        n.append(c.total())
                        sizes.append(len(c))
                        names += c.keys()
                        tfs += c.values()
                edge = np.cumsum(sizes).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(edge, pa.array(names, pa.binary()).cast(pa.string())),
                     pa.ListArray.from_arrays(edge, pa.array(tfs, pa.int64()))], names=["id", "n", "terms", "tfs"])

    return src.mapInArrow(run, f"id {id_type}, n bigint, terms array<string>, tfs array<bigint>")


def _invert(key, table):
    """Postings of one slice: a head row with the ids in their order, then (term, tf, places) by term and tf."""
    m, part = (k.as_py() for k in key)
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end")
    table = table.select(["id", "terms", "tfs"]).take(order).combine_chunks()
    lists = table.column("terms").combine_chunks()
    ids = table.column("id").combine_chunks()
    place = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    code, tf = coded.indices.to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
    order = np.lexsort((place, tf, code))
    code, tf, place = code[order], tf[order], place[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])))
    n = len(first) + 1
    edge = np.concatenate([[0, 0], first[1:], [len(code)]]).astype(np.int32)
    return pa.table({
        "m": np.full(n, m), "part": np.full(n, part, np.int32),
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(code[first]))]),
        "tf": np.append(0, tf[first]), "places": pa.ListArray.from_arrays(edge, pa.array(place)),
        "ids": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                                 pa.nulls(n - 1, pa.list_(ids.type))])})


class Index:
    """The written index: ``postings`` (m, part, term, tf, places, ids), ``N`` documents and ``L`` terms.

    The row of a slice without a term lists its documents' ids.
    """

    def __init__(self, postings: DataFrame, n_docs: int, n_terms: int):
        self.postings, self.n_docs, self.n_terms = postings, n_docs, n_terms

    def drop(self) -> None:
        drop_stage(self.postings)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                slice_terms: int = SLICE_TERMS) -> Index:
    """Index every term of every row of ``docs``."""
    # the row number is written once, so it is the same whenever it is read
    forward = stage(term_counts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "lex-forward")
    n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(BASE) + F.expr(f"({SLOPE} * n * {n_docs}L) div {max(n_terms, 1)}L")
    strata = (forward.select(m.alias("m"), "n").groupBy("m")
              .agg(F.ceil(F.sum("n") / slice_terms).alias("parts")))
    sliced = (forward.withColumn("m", m).join(strata, "m")
              .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
              .select("m", "part", "row", "id", "terms", "tfs"))
    id_type = forward.schema["id"].dataType.simpleString()
    postings = sliced.groupBy("m", "part").applyInArrow(
        _invert, f"m bigint, part int, term string, tf bigint, places array<int>, ids array<{id_type}>")
    postings = stage(postings, "lex-index", release=True)
    drop_stage(forward)
    return Index(postings, n_docs, n_terms)


def _visitor(wanted: dict[int, list[str]], weights: dict[str, int], k: int, m_impact):
    """The function that scores one slice for the items that visit it."""
    def visit(key, postings, visits):
        none = pa.table({"item": pa.array([], pa.int64()), "id": pa.array([], id_type(postings)),
                         "score": pa.array([], pa.int64())})
        if not postings.num_rows or not visits.num_rows:
            return none
        m = key[0].as_py()
        head = pc.is_null(postings.column("term"))
        ids = postings.filter(head).column("ids").combine_chunks().flatten()
        own = postings.filter(pc.invert(head)).select(["term", "tf", "places"]).sort_by("term").combine_chunks()
        if not own.num_rows:
            return none
        terms = own.column("term").to_pylist()
        w = np.array([weights[t] for t in terms], np.int64)
        lists = own.column("places").combine_chunks()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        place = lists.flatten().to_numpy()
        # once for each term and frequency
        gain = np.repeat(w * m_impact(own.column("tf").to_numpy(), m), size)
        edge = np.append(0, np.cumsum(size))
        where: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(terms):
            where[t] = (where[t][0] if t in where else edge[i], edge[i + 1])
        items, docs, scores = [], [], []
        for item, floor in zip(visits.column("item").to_pylist(), visits.column("floor").to_numpy()):
            spans = [where[t] for t in wanted[item] if t in where]
            if not spans:
                continue
            at = np.concatenate([place[a:b] for a, b in spans])
            # sums of integers below 2^53 are exact in doubles
            total = np.bincount(at, np.concatenate([gain[a:b] for a, b in spans]), len(ids)).astype(np.int64)
            good = np.flatnonzero(total >= max(floor, 1))
            if len(good) > k:
                # the k best, equal scores by place, which is the order of the ids
                cut = np.partition(total[good], len(good) - k)[len(good) - k]
                above = good[total[good] > cut]
                good = np.sort(np.concatenate([above, good[total[good] == cut][:k - len(above)]]))
            items.append(np.full(len(good), item))
            docs.append(good)
            scores.append(total[good])
        if not items:
            return none
        return pa.table({"item": np.concatenate(items), "id": ids.take(pa.array(np.concatenate(docs))),
                         "score": np.concatenate(scores)})

    def id_type(postings):
        return postings.schema.field("ids").type.value_type

    return visit


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _best(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search_block(index: Index, items: DataFrame, k: int) -> DataFrame:
    """(item, rank, id, score) for one block of items (item, terms)."""
    spark = items.sparkSession
    asked = items.select("item", F.explode("terms").alias("term"))
    pick = asked.select("term").distinct()
    found = index.postings.where("term is not null").join(pick, "term")
    # a row for each term of the block
    df = found.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weigh = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = stage(df.select("term", weigh.alias("w")), "lex-weights")
    weight = {r.term: r.w for r in weights.collect()}
    wanted: dict[int, list[str]] = {}
    for r in items.collect():                            # bounded by BLOCK_TERMS
        wanted[r.item] = sorted(t for t in r.terms if t in weight)

    most = (found.groupBy("m", "term").agg(F.max("tf").alias("tf"), F.sum(F.size("places")).alias("docs"))
            .join(F.broadcast(weights), "term"))         # BLOCK_TERMS rows at most
    top = F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")
    bounds = stage(asked.join(most.select("m", "term", "docs", top.alias("top"), (F.col("w") > 0).alias("counts")), "term")
                   .groupBy("item", "m").agg(F.sum("top").alias("bound"),
                                             F.coalesce(F.max(F.when(F.col("counts"), F.col("docs"))), F.lit(0)).alias("sure"))
                   .where("bound > 0"), "lex-bounds")
    before = (Window.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1))
    ranked = bounds.withColumn("first", F.coalesce(F.sum("sure").over(before), F.lit(0)) < k)

    def visited(visits: DataFrame, name: str) -> DataFrame:
        slices = index.postings.where("term is null").select("m", F.col("part").alias("slice"))
        asked_here = visits.join(slices, "m").select(F.col("m").alias("stratum"), "slice", "item", "floor")
        here = visits.select("m").distinct()
        rows = index.postings.join(pick, "term", "left_semi").unionByName(index.postings.where("term is null"))
        rows = rows.join(here, "m", "left_semi")
        kind = index.postings.schema["ids"].dataType.elementType.simpleString()
        scored = (rows.groupBy("m", "part").cogroup(asked_here.groupBy("stratum", "slice"))
                  .applyInArrow(_visitor(wanted, weight, k, impact), f"item bigint, id {kind}, score bigint"))
        return stage(scored, name)

    one = visited(ranked.where("first").select("item", "m", F.lit(1).cast("long").alias("floor")), "lex-first")
    floors = _best(one, k).where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    rest = (ranked.where("not first").join(floors, "item", "left")
            .select("item", "m", "bound", F.coalesce("floor", F.lit(1).cast("long")).alias("floor"))
            .where("bound >= floor").select("item", "m", "floor"))
    two = visited(rest, "lex-rest")
    return _best(one.unionByName(two), k).select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text",
           doc_col: str = "doc_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(id, rank, doc, score): the ``k`` best documents of every item, those of score 0 left out."""
    items = stage(term_counts(queries, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "lex-items")
    blocks = -(-items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] // block_terms)
    out = None
    for b in range(max(1, blocks)):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))) == b)
        got = search_block(index, own.select("item", "terms"), k)
        out = got if out is None else out.unionByName(got)
    return (out.withColumnRenamed("id", "doc").join(items.select("item", F.col("id").alias("asked")), "item")
            .select(F.col("asked").alias(id_col), "rank", F.col("doc").alias(doc_col), "score"))
