"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots, bytes and rows are summed per
slot, and a slot-to-shard map says where each slot lives. The map is a small
versioned table (one row per slot and version), built by giving the heaviest
slots first to the lightest shard, and *edited* when loads or the number of
shards change: an edit moves only the slots it must, as a new version.

The law kept is ``bytes``: shards hold nearly equal bytes. Records are hashed
one by one (id, text checksum, size, and which of equal records it is), so
neither a large group of equal texts nor one row repeated overloads a slot.

Defined results: a null text counts as empty, size 1; repeated rows are spread
and get positions of their own; within a slot records stand by id (none first),
checksum, size and copy; a text of any length is one record; an empty table
gives no rows; of the input only id and text are read, so further columns of
any name do no harm.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cohortlens.llm.common import COPY_RUN, numbered_copies, stage, stage_path

SLOTS = 8192
PART_ROWS = 1_000_000       # records that are numbered together


@dataclass(frozen=True)
class SlotMap:
    """``shard[v]`` is the shard of virtual slot ``v``."""

    version: int
    shard: tuple[int, ...]


def build_map(load: list[int], shards: int) -> SlotMap:
    """Version 1: heaviest slots first, each to the lightest shard so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * len(load)
    for v in sorted(range(len(load)), key=lambda v: (-load[v], v)):
        size, slots, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (size + load[v], slots + 1, s))
    return SlotMap(1, tuple(out))


def edit_map(old: SlotMap, load: list[int], shards: int, tolerance: float = 0.01) -> SlotMap:
    """Next version: move slots from the heaviest shards to the lightest ones until even.

    Slots of shards that no longer exist go first. Every other move lowers the
    spread, so slots that are well placed stay where they are.
    """
    out = list(old.shard)
    size = [0] * shards
    mine: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for v, s in enumerate(out):
        if s < shards:
            size[s] += load[v]
            mine[s].append(v)
        else:
            homeless.append(v)
    for v in sorted(homeless, key=lambda v: (-load[v], v)):
        s = min(range(shards), key=lambda s: (size[s], s))
        out[v], size[s] = s, size[s] + load[v]
        mine[s].append(v)
    limit = tolerance * sum(load) / shards
    while True:
        hi = max(range(shards), key=lambda s: (size[s], -s))
        lo = min(range(shards), key=lambda s: (size[s], s))
        gap = size[hi] - size[lo]
        fit = [v for v in mine[hi] if 0 < load[v] < gap]
        if gap <= limit or not fit:
            break
        v = min(fit, key=lambda v: (abs(gap / 2 - load[v]), v))
        mine[hi].remove(v)
        mine[lo].append(v)
        out[v] = lo
        size[hi] -= load[v]
        size[lo] += load[v]
    return SlotMap(old.version + 1, tuple(out))


def write_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Append the map's version to the map table at ``path``."""
    spark.createDataFrame([(m.version, v, s) for v, s in enumerate(m.shard)],
                          "version int, vslot int, shard int").coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version (the latest by default); as many rows as there are slots."""
    table = spark.read.parquet(path)
    version = version or table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).orderBy("vslot").collect()
    return SlotMap(version, tuple(r["shard"] for r in rows))


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, copy, vslot) of every row; the text itself goes no further.

    Rows equal in all of these are counted and numbered by ``copy``, which is
    hashed with the rest: repeated rows are spread like any others, and the
    result does not depend on how the input is cut.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    each = numbered_copies(rows, COPY_RUN)
    return each.withColumn("vslot", F.pmod(F.xxhash64(id_col, "text_crc32", "size", "copy"), F.lit(slots)).cast("int"))


def slot_loads(recs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """(bytes, rows) per slot; ``slots`` rows reach the driver, whatever the input."""
    load, rows = [0] * slots, [0] * slots
    for r in recs.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        load[r["vslot"]], rows[r["vslot"]] = r["b"], r["n"]
    return load, rows


def place(recs: DataFrame, m: SlotMap, rows: list[int], id_col: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot``: the record's position in its shard, gapless from 0.

    Positions run through a shard's virtual slots in order, and through the
    parts of a slot, of about ``PART_ROWS`` rows each. A part's first position
    comes from the row counts, so only rows of one part are numbered together;
    within it they stand by id, checksum, size and copy.
    """
    spark = recs.sparkSession
    parts = max(1, -(-max(rows, default=0) // PART_ROWS))
    recs = recs.withColumn("part", F.pmod(F.xxhash64(F.lit(3), id_col, "text_crc32", "size", "copy"), F.lit(parts)).cast("int"))
    sizes = {(v, 0): n for v, n in enumerate(rows)} if parts == 1 else {
        (r["vslot"], r["part"]): r["n"] for r in recs.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    at: dict[int, int] = {}
    first = []
    for v, s in enumerate(m.shard):
        for p in range(parts):
            first.append((v, p, s, at.get(s, 0)))
            at[s] = at.get(s, 0) + sizes.get((v, p), 0)
    # a row for each slot and part: 8,192, or rows / PART_ROWS x the unevenness of the slots
    where = F.broadcast(spark.createDataFrame(first, "vslot int, part int, shard int, first long"))
    number = F.row_number().over(Window.partitionBy("vslot", "part").orderBy(id_col, "text_crc32", "size", "copy"))
    return (recs.withColumn("n", number).join(where, ["vslot", "part"])
            .withColumn("slot", F.col("first") + F.col("n") - 1).drop("n", "first", "part", "copy"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, vslot, shard, slot, map_version) for every row of ``docs``."""
    spark = docs.sparkSession
    recs = stage(records(docs, slots, id_col), "shard-records")
    load, rows = slot_loads(recs, slots)
    path = stage_path(spark, "slot-map")
    write_map(spark, build_map(load, shards), path)
    m = read_map(spark, path)
    if max(load, default=0):
        edited = edit_map(m, load, shards)
        if edited.shard != m.shard:
            write_map(spark, edited, path)
            m = read_map(spark, path)
    return place(recs, m, rows, id_col).withColumn("map_version", F.lit(m.version))
