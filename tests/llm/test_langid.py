"""Language identification: held-out accuracy and edge cases."""

import numpy as np

from versio.llm import langid as L
from versio.llm.queries import registry


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = registry()["op9_centroid_language_id"][0](spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    rows = out.where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_counts_do_not_depend_on_blocks(monkeypatch):
    """A text's n-grams are counted whole, but for at most a few at block ends."""
    text = "the quick brown fox " * 300
    whole = L.ngram_counts(text)
    monkeypatch.setattr(L, "CHARS", 1000)
    assert np.abs(L.ngram_counts(text) - whole).sum() <= 0.02 * whole.sum()
    assert L.ngram_counts("").sum() == 0
    assert (L.ngram_counts("A-b") == L.ngram_counts("a  b")).all()


def test_edge_cases(spark):
    rows = [(1, "der die das und nicht", "de"), (2, "the and of not", "en"), (2, "the and of not", "en"), (3, None, "en"),
            (4, "", "de"), (5, "12 34 !?", "de"), (6, "die und das", None), (None, "of the", "en"), (7, "the " * 200_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS centroid")
    model = L.train(docs, max_sample=3, centroids=2)
    assert set(model["langs"]) == {"de", "en"}
    got = {(r["doc_id"], r["text"]): r["language"] for r in L.predict(docs, model).collect()}
    assert got[(6, "die und das")]["lang"] == "de" and got[(None, "of the")]["lang"] == "en"
    assert got[(7, "the " * 200_000)]["lang"] == "en"
    for key in ((3, None), (4, ""), (5, "12 34 !?")):
        assert (got[key]["lang"], got[key]["score"], got[key]["rejected"]) == ("und", 0.0, True)
    assert L.train(docs.where("false")) is None
    assert L.predict(docs.where("doc_id = 1"), None).first()["language"]["lang"] == "und"
    assert L.predict(docs.where("false"), model).count() == 0


def test_far_texts_are_rejected(spark):
    rows = [(f"the and of it is that {i} with from", "en") for i in range(60)] + [(f"der die das und nicht {i} mit", "de") for i in range(60)]
    model = L.train(spark.createDataFrame(rows, "text string, lang string"))
    got = L.predict(spark.createDataFrame([("the and of it is that with from",), ("zzqx xkcd qqq wwv",)], "text string"), model).collect()
    assert [r["language"]["rejected"] for r in got] == [False, True]


def test_language_of_mostly_copies(spark):
    """Copies of a text do not push a language's other texts out of the sample."""
    hot = spark.range(20_000).selectExpr("'the and of it is that' AS text", "'en' AS lang")
    rows = [(f"the and of {chr(97 + i % 26) * 3} with {chr(97 + i // 26) * 4}", "en") for i in range(40)]
    rows += [(f"der die das und {chr(97 + i % 26) * 3}", "de") for i in range(26)]
    model = L.train(hot.unionByName(spark.createDataFrame(rows, "text string, lang string")), max_sample=20, centroids=20)
    assert set(model["langs"]) == {"de", "en"} and model["langs"].count("en") >= 15
