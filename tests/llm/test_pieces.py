import numpy as np
import pyarrow as pa
import sentencepiece

from cohortlens.llm import pieces as P
from cohortlens.llm.common import chunks, mix


def encode(texts, dropout, seed=0):
    enc, out = P.Encoder(P.Pieces(P._model(P.MODEL)), seed, dropout, 4), []
    for rows, b, off in chunks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t"):
        flat, at = enc.encode(b, off, mix(np.arange(rows.start, rows.stop).astype(np.uint64)))
        out += [flat[at[i]:at[i + 1]].tolist() for i in range(len(at) - 1)]
    return out


TEXTS = ["hello world", "  a\tb\n\nc  ", "ﬁ Ａ é 日本 \xa0x", "", " ", "\x00a", "abc" * 40, "   \n  x " * 5, "😀😀 ok",
         "longword" * 30 + " z", "The quick brown fox, jumps over 12 lazy dogs.\nAgain and again and again."]


def test_without_dropout_it_is_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    assert encode(TEXTS, 0.0) == [sp.encode(t) for t in TEXTS]


def test_dropout_is_seeded_and_lossless(monkeypatch):
    texts = TEXTS + ["literal ▁ stays ▁▁"] + ["again and again the same words come back"] * 20
    one, two = encode(texts, 0.1, 1), encode(texts, 0.1, 2)
    assert one == encode(texts, 0.1, 1) != two
    assert len({tuple(x) for x in one[-20:]}) > 1            # equal words, other segmentations
    monkeypatch.setattr(P, "LONG", 1)                          # the heap and the arrays agree
    assert encode(texts, 0.1, 1) == one
    p = P.Pieces(P._model(P.MODEL))
    for ids, text in zip(one, texts):
        raw, _ = P.decode_flat(p, np.array(ids, np.int32), np.array([0, len(ids)]))
        assert raw.tobytes().decode() == text
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    assert sp.decode(one[-1]) == texts[-1]


def test_rows(awkward, clashing, empty):
    out = P.encode_documents(clashing)
    rows = P.decode_documents(out).collect()
    assert all(r.lossless for r in rows)
    want = sorted((str(r.doc_id), r.text) for r in awkward.collect() if r.text is not None)
    assert sorted((str(r.doc_id), r.text) for r in rows if r.text is not None) == want
    assert [r.ids for r in rows if r.doc_id == 50] == [None] and [r.ids for r in rows if r.doc_id == 51] == [[]]
    assert P.encode_documents(empty).count() == 0


def test_every_occurrence_skips_merges_of_its_own(spark, monkeypatch):
    texts = ["internationalisation"] * 600 + ["x internationalisation " * 20]
    got = encode(texts, 0.1, 1)
    assert len({tuple(x) for x in got[:600]}) > 20
    p = P.Pieces(P._model(P.MODEL))
    # kept merges and repeated agenda give what the agenda alone gives
    enc = P.Encoder(p, 1, 0.1)
    lo, cp = 0, np.array([P.BLANK] + [ord(c) for c in texts[0]], np.uint32)
    h = P.Rolling(mix(cp.astype(np.uint64) + P.U64(1))).range(np.array([0]), np.array([len(cp)]))
    for i in range(600):
        row = mix(np.array([i], np.uint64))
        key = mix(h ^ mix(row ^ mix(np.array([0], np.uint64) ^ enc.seed)))
        assert got[i] == P.merge_one(p, p.char_id[cp].tolist(), int(key[0]), enc.limit)
    docs = spark.createDataFrame([(1, texts[-1])] * 3 + [(2, texts[-1])], "doc_id long, text string")
    rows = P.encode_documents(docs, copies=True).collect()
    assert len({tuple(r.ids) for r in rows}) == 4 and all(r.lossless for r in rows)
    assert sorted(r.ids for r in P.encode_documents(docs.repartition(3), copies=True).collect()) == sorted(r.ids for r in rows)
    assert len({tuple(r.ids) for r in P.encode_documents(docs).collect()}) == 2
