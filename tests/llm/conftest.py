import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("It thtiing oned en and edeaes in onsthe reinheon ered blent erwh it tion and onbleer thon of with by or "
         "atha ndre oneaan as onanhe ing inon at that ea antionea nd thre reernt erre thinges ed ntha eses edha "
         "theaor wh erthtion oneren lyorin an ndhast thonea lyestion haes thbleen onlyhe this atshsh erin ntreou "
         "rehaer edin the ofndwhha ntsh thndreou ofonerheth erntsh ernt stnt")


def awkward_rows():
    """Nulls in every column, empty and blank texts, one very long text and word, ties, repeated rows."""
    prose = [(i, " ".join(PROSE.split()[i % 7:]) + f" w{i} x{i * 7}", "en" if i % 3 else "de", f"s{i % 4}", 1)
             for i in range(1, 40)]
    return prose + [
        (50, None, "en", "s1", None), (51, "", "en", "s1", 0), (52, " \n\t ", None, None, 3),
        (53, "one", "en", "s2", 3), (54, "one two", "en", "s2", 7),
        (55, "Grüße 日本 😀 ▁ \x00 end", "de", None, None),
        (56, (PROSE + "\n") * 400, "en", "s3", None), (57, "x" * 30_000, "en", "s3", None),
        (58, PROSE, "en", "s0", None), (58, PROSE, "en", "s0", None), (59, PROSE, "en", "s0", None),
        (None, PROSE + " tail", "en", "s0", None), (None, None, None, None, None),
        (60, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" mail a.b@c.example.com ip 10.0.0.1', "en", "s1", None),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = ["id", "d", "fp", "row", "size", "key", "n", "p", "spans", "doc", "nth", "gone", "component_id", "kept",
           "copies", "target", "bucket", "shard", "slot", "ids", "cand", "base", "gram", "block", "c", "k"]


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F
    return awkward.select("*", *[F.lit("extra").alias(c) for c in CLASHES])
