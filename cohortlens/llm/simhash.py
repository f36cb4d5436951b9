"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two
fingerprints within the radius share a variant, so one shuffle on variants
brings every linked pair together. A bucket of an even radius holds only
fingerprints that are pairwise within it (triangle inequality), hence it needs
one edge from its smallest member to each other one; the distance of each
emitted pair is verified. The size of a bucket is bounded by the size of the
ball (65 at radius 2), whatever the number of texts, because equal
fingerprints are collapsed first.

Defined results: a null or empty text has fingerprint zero, linked like any
other; a text of fewer words than the shingle is one shingle; repeated rows
get the same component; a component without any id has a null component id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cohortlens.llm.common import chunks, stage, start, word_bounds
from cohortlens.llm.components import connected_components


def normalised(b: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased words joined by single spaces: (bytes, start, end, text number)."""
    ws, we, doc = word_bounds(b, off)
    length = we - ws
    new_start = np.zeros(len(ws), np.int64)
    np.cumsum(length[:-1] + 1, out=new_start[1:]) if len(ws) else None
    total = int(new_start[-1] + length[-1]) if len(ws) else 0
    out = np.full(total, 32, np.uint8)
    src = np.zeros(len(b) + 1, np.int8)
    src[ws] = 1
    src[we] -= 1
    inside = np.cumsum(src[:-1]).astype(bool)
    dst = np.zeros(total + 1, np.int8)
    dst[new_start] = 1
    dst[new_start + length] -= 1
    out[np.cumsum(dst[:-1]).astype(bool)] = b[inside]
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out.tobytes(), new_start, new_start + length, doc


def fingerprint_chunk(b: np.ndarray, off: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """SimHash of each text: bit set where over half of the shingle hashes set it."""
    n = len(off) - 1
    result = np.zeros(n, np.uint64)
    joined, ws, we, doc = normalised(b, off)
    if not len(ws):
        return result
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    j = np.arange(len(ws))
    last_in_doc = (first + words - 1)[doc]
    stop = np.minimum(j + shingle - 1, last_in_doc)
    use = (j + shingle - 1 <= last_in_doc) | (j == first[doc])
    lo, hi, owner = ws[use], we[stop[use]], doc[use]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(lo.tolist(), hi.tolist())),
                    np.uint64, count=len(lo))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    count = np.bincount(owner, minlength=n)
    have = np.flatnonzero(count)
    starts = (np.cumsum(count) - count)[have]
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > count[have][:, None], axis=1, bitorder="little")
    result[have] = packed.view(np.uint64).ravel()
    return result


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; ``fp`` holds the 64 bits as a signed long."""
    start(docs)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for rows, b, off in chunks(batch, "text", 1 << 20):
                fp = fingerprint_chunk(b, off, shingle, seed)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, rows.stop - rows.start), pa.array(fp.view(np.int64))],
                    names=["id", "fp"])

    return src.mapInArrow(run, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def _masks(radius: int) -> list[int]:
    out = []
    for k in range(radius + 1):
        for bits in combinations(range(64), k):
            m = sum(1 << i for i in bits)
            out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def ball_links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """Verified links (a < b) between distinct fingerprints ``fp``.

    Even distance: enough links to join each bucket's members (a star). Odd
    distance: buckets reach one bit beyond the radius, so all pairs of a
    bucket (bounded by the ball) are verified.
    """
    half = (max_distance + 1) // 2
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(half)])
    rows = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    w = Window.partitionBy("variant")
    if max_distance % 2 == 0:
        pairs = (rows.withColumn("a", F.min("fp").over(w)).where("fp != a")
                 .select("a", F.col("fp").alias("b")))
    else:
        pairs = (rows.withColumn("all", F.collect_list("fp").over(w)).where(F.size("all") > 1)
                 .select(F.col("fp").alias("a"), F.explode("all").alias("b")).where("a < b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, max_distance: int = 2, seed: int = 42,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    fp = stage(fingerprints(docs, shingle, seed, id_col, text_col), "simhash-fp")
    nodes = stage(fp.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-nodes")
    comp = connected_components(ball_links(nodes.select("fp"), max_distance))
    linked = nodes.join(comp, nodes.fp == comp.node).select("fp", "root", "first")
    root = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    of_fp = linked.join(root, "root").select("fp", "smallest")
    mapping = stage(nodes.join(of_fp, "fp", "left")
                    .select("fp", F.coalesce("smallest", "first").alias("component_id")), "simhash-map")
    return fp.join(mapping, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp="fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one_per_group(docs: DataFrame, shingle: int = 3, max_distance: int = 2, seed: int = 42) -> DataFrame:
    """One row of each component; columns unchanged.

    It is the row with the smallest id, a row without an id only where the
    component holds no id; ties go by a hash of the row, equal rows count once.
    An id on texts of two components is a row of each of them.
    """
    # nulls do not change a hash, so each column goes in with its null sign; maps cannot be hashed
    cols = ["doc_id", "text"] + [f.name for f in docs.schema if f.name not in ("doc_id", "text")
                                 and "map<" not in f.dataType.simpleString()]
    parts = [x for c in cols for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"),
                                F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")).alias("row"),
                       F.col("text").alias("body"), F.struct("*").alias("doc"))        # no column can clash
    fp = fingerprints(rows, shingle, seed, "row", "body")
    nodes = stage(fp.groupBy("fp").agg(F.min("row").alias("first")), "simhash-nodes")
    comp = connected_components(ball_links(nodes.select("fp"), max_distance))
    stay = stage(nodes.join(comp, nodes.fp == comp.node, "left")
                 .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("row"))
                 .select("row.h1", "row.h2"), "simhash-stay")
    # equal rows are dropped in each task before the shuffle, so none gathers them
    once = rows.select("row.h1", "row.h2", "doc").dropDuplicates(["h1", "h2"])
    return once.join(stay, ["h1", "h2"], "left_semi").select("doc.*")
