import collections

import corpus_pipeline
from cohortlens.llm import pieces, quality_rules, secrets, simhash
from tests.llm.test_quality_rules import brute


def test_stages_take_awkward_tables(spark, clashing, empty):
    for docs in (clashing, empty):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_run_is_the_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = [r for r in docs.collect() if brute(r.text)["kept"]]
    first = corpus_pipeline.quality(spark, docs, sf)
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in good)
    comp = {r.doc_id: r.component_id for r in simhash.simhash_components(first).collect()}
    left = {r.doc_id: r.text for r in good if comp[r.doc_id] == r.doc_id}
    masked = {d: secrets.mask(t, secrets.scan(t)[1]) for d, t in left.items()}
    out = corpus_pipeline.run(spark, sf)
    rows = pieces.decode_documents(out).collect()
    seen = collections.Counter(r.doc_id for r in rows)
    assert set(seen) <= set(masked) and max(seen.values()) <= 2 and len(rows) > len(masked)
    assert all(r.text == masked[r.doc_id] and r.lossless for r in rows)
    assert quality_rules.RepetitionRules().min_words == 50
