import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import language_id as L
from cohortlens.llm.common import read_table
from tests.conftest import SMALL


def naive(texts, train, max_n=3, bits=10, smoothing=0.5):
    """[(language, posterior)] from counts kept in dictionaries of the same buckets."""
    def buckets(text):
        b = np.frombuffer(text.encode(), np.uint8)
        return [g for n in L.text_grams(b, np.array([0, len(b)]), max_n, bits)[0] for g in n[0].tolist()]

    counts, rows = {}, {}
    for lang, text in train:
        rows[lang] = rows.get(lang, 0) + 1
        for g in buckets(text):
            counts.setdefault(lang, {})[g] = counts.setdefault(lang, {}).get(g, 0) + 1
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        sums = {}
        for lang in sorted(rows):
            c = counts.get(lang, {})
            total = sum(c.values()) + smoothing * (1 << bits)
            sums[lang] = np.log(rows[lang] / sum(rows.values())) + sum(
                np.log((c.get(g, 0) + smoothing) / total) for g in buckets(text))
        best = max(sums, key=lambda x: sums[x])
        out.append((best, 1 / sum(np.exp(v - sums[best]) for v in sums.values())))
    return out


def test_folding():
    b = "Ab,  Ç9d".encode()
    sym, edge = L.folded(np.frombuffer(b + b"..", np.uint8), np.array([0, len(b), len(b) + 2, len(b) + 2]))
    assert ["".join(map(chr, sym[lo:hi])) for lo, hi in zip(edge, edge[1:])] == [" ab ç d ", " ", " "]


def test_posteriors_match_naive_counts(spark):
    train = [("en", "the cat and the hat"), ("fr", "le chat et la rue"), ("en", "of the house"), ("de", "der Hund und die Katze"),
             (None, "nobody knows"), ("fr", None)]
    texts = ["the hat", "la rue", "Katze", "x", "", None, "12 34", "the la der"]
    model = L.train(spark.createDataFrame(train, "lang string, text string"), max_n=3, bits=10)
    assert model.languages == ["de", "en", "fr"]
    got = L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    want = naive(texts, [(a, b) for a, b in train if a and b])
    for r, (lang, score) in zip(sorted(got, key=lambda r: r.doc_id), want):
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-4)


def test_awkward_rows(spark, awkward, clashing, empty):
    for docs in (awkward, clashing):
        got = L.identify(docs).collect()
        assert len(got) == docs.count()
        assert {r.lang_pred for r in got} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r for r in got}
        assert [by[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert L.identify(empty).count() == 0
    blind = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.identify(blind).collect()} == {("und", 0.0)}


def test_labels_of_the_held_out_fold_are_not_used(awkward):
    wrong = awkward.withColumn("lang", F.when(L.fold() == 1, "zz").otherwise(F.col("lang")))
    rows = lambda df: sorted(map(str, L.identify(df).collect()))
    assert rows(wrong) == rows(awkward)


def test_equal_posteriors_take_the_first_name(spark):
    model = L.train(spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string"))
    got = L.predict(spark.createDataFrame([(1, "same")], "doc_id long, text string"), model).first()
    assert (got.lang_pred, got.score) == ("a", 0.5)


def test_too_many_languages_are_an_error(spark):
    rows = [(f"l{i}", "text") for i in range(L.MAX_LANGUAGES + 1)]
    with pytest.raises(ValueError):
        L.train(spark.createDataFrame(rows, "lang string, text string"))


def test_held_out_accuracy(spark):
    docs = read_table(spark, SMALL, "documents")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
