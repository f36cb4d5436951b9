import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing
from cohortlens.llm.mixing import apply_mix, mix_sources, pivot_round
from cohortlens.llm.sharding import SlotMap, build_map, edit_map, read_map, shard_documents, write_map


def water_fill(size, weight, total):
    """Targets by repeated resharing, one source at a time."""
    out, open_ = {}, set(size)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * size[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * size[s]
            open_.discard(s)
    return out


def test_targets_copies_and_reruns(awkward, clashing):
    rows = mix_sources(awkward).collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = water_fill(dict(size), weight, 1.5 * sum(size.values()))
    taken, longest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mix_sources(clashing.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(again) == key(rows)


def test_many_buckets_and_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "FANIN", 4)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('a ', cast(1 + id % 13 as int)) as text",
                                        "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    rows = mix_sources(docs).collect()
    assert len(rows) == 3000
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 13 for s in target)


def test_pivot_keeps_mass_and_expectation():
    size = np.array([5.0, 3.0, 8.0, 1.0, 2.0, 7.0])
    p0 = np.array([0.3, 0.7, 0.5, 0.9, 0.2, 0.4])
    rng, mean = np.random.default_rng(3), np.zeros(6)
    for _ in range(4000):
        p, rest = pivot_round(p0, size, rng.random(6))
        assert (p * size).sum() == pytest.approx((p0 * size).sum())
        assert all(x in (0.0, 1.0) for k, x in enumerate(p) if k != rest)
        mean += p / 4000
    assert np.abs(mean - p0).max() < 0.03


def test_apply_mix_repeats_rows(clashing, empty):
    out = apply_mix(clashing)
    assert out.columns == clashing.columns
    want = collections.Counter()
    for r in mix_sources(clashing).collect():
        want[str(r.doc_id)] += r.copies
    got = collections.Counter(str(r.doc_id) for r in out.collect())
    assert sum(got.values()) > 0 and got["58"] <= 4
    assert got.keys() <= want.keys()
    assert apply_mix(empty).count() == 0 and mix_sources(empty).count() == 0


def test_apply_mix_sorts_only_rows_that_share_unevenly(spark):
    """Equal rows share out their copies exactly; the texts go past a hash table of the copies, in one shuffle."""
    rows = ([(1, "a b c", "en", "s0", None)] * 5 + [(2, "d e f g", "en", "s0", None)] * 2
            + [(i, "w " * (i % 9 + 1), "en", f"s{i % 3}", None) for i in range(3, 60)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = collections.Counter()
    for r in mix_sources(docs.withColumn("doc_id", F.xxhash64("doc_id", "text")), id_col="doc_id").collect():
        want[r.doc_id] += r.copies
    out = apply_mix(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    got = collections.Counter(r.k for r in out.select(F.xxhash64("doc_id", "text").alias("k")).collect())
    assert got == collections.Counter({k: c for k, c in want.items() if c})


def test_shards(awkward, clashing, empty):
    rows = shard_documents(clashing, shards=4).collect()
    assert len(rows) == awkward.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
    text = {r.doc_id: r.text or "" for r in awkward.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            raw = text[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert shard_documents(empty, shards=4).count() == 0


def test_slot_map_versions(spark, tmp_path):
    load = [(i * 37) % 101 + 1 for i in range(500)]
    m = build_map(load, 16)
    size = np.bincount(m.shard, weights=load, minlength=16)
    assert size.max() - size.min() <= max(load)
    grown = edit_map(m, load, 17)
    moved = [v for v in range(500) if grown.shard[v] != m.shard[v]]
    assert 0 < len(moved) < 500 / 10 and grown.version == 2
    size = np.bincount(grown.shard, weights=load, minlength=17)
    assert size.max() - size.min() <= 0.02 * size.mean()
    fewer = edit_map(grown, load, 16)
    stayed = sum(fewer.shard[v] == grown.shard[v] for v in range(500))
    assert max(fewer.shard) == 15 and fewer.version == 3 and stayed > 500 * 0.85
    path = str(tmp_path / "map")
    for x in (m, grown):
        write_map(spark, x, path)
    assert read_map(spark, path) == grown and read_map(spark, path, 1) == m
    assert edit_map(SlotMap(1, (0,) * 8), [5] * 8, 2).shard.count(1) == 4


def test_repeated_rows_are_spread(spark, monkeypatch):
    """A quarter of the table is one row repeated: shards stay even, and the result does not depend on the partitions."""
    from pyspark.sql import functions as F
    from cohortlens.llm import sharding
    monkeypatch.setattr(sharding, "COPY_RUN", 700)
    monkeypatch.setattr(sharding, "PART_ROWS", 3)
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 4 == 0, F.repeat(F.lit("hot "), 20)).otherwise(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    got = shard_documents(rows, shards=16).collect()
    assert len(got) == 20_000 and sum(r.doc_id == -1 for r in got) == 5000
    load = np.bincount([r.shard for r in got], weights=[r["size"] for r in got], minlength=16)
    assert load.max() - load.min() <= 81                         # one row's bytes
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    again = shard_documents(rows.repartition(7), shards=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeated_rows_mix_like_others(spark, monkeypatch):
    """A third of the rows are one row: each copy is rounded by a key of its own, and reruns agree."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(-1, "one two three", "a")] * 600 + [(i, "w " * (1 + i % 9), "a" if i % 3 else "b") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert len(got) == 1800
    hot = collections.Counter(r.copies for r in got if r.doc_id == -1)
    assert sum(hot.values()) == 600 and len(hot) == 2 and min(hot.values()) > 20
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
