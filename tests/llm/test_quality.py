"""Quality classifier: held-out accuracy, shrinkage, and edge cases."""

import math

import numpy as np

from versio.llm import quality as Q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = Q.score_documents(docs, labels.where("doc_id % 5 != 0")).join(labels.where("doc_id % 5 = 0"), "doc_id")
    rows = out.selectExpr("quality", "quality_score.keep AS keep").collect()
    bad, good = [r["keep"] for r in rows if not r["quality"]], [r["keep"] for r in rows if r["quality"]]
    assert len(bad) > 50 and np.mean(bad) <= 0.05 and np.mean(good) >= 0.99


def test_site_posteriors_shrink(spark):
    """Against the formulas: a path with one document stays near its host, a
    host with few near the corpus; large ones keep their own share."""
    rows = [("a", "x", 4.0)] * 400 + [("b", "x", -4.0)] * 300 + [("b", "y", 4.0)] + [("c", "x", -4.0)] * 2 + [("d", "z", 4.0)] * 100
    df = spark.createDataFrame(rows, "host string, path string, evidence double").repartition(3)
    sites, mean = Q.site_posteriors(df, 0.6)
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    odds = math.log(0.6 / 0.4)
    p = {e: 1 / (1 + math.exp(-(e + odds))) for e in (4.0, -4.0)}
    assert abs(mean - (501 * p[4.0] + 302 * p[-4.0]) / 803) < 1e-9
    assert got["a", "x"]["path_p"] > 0.95 and got["b", "x"]["path_p"] < 0.06
    lone, host = got["b", "y"], got["b", "x"]["host_p"]
    assert host < lone["path_p"] < p[4.0] and lone["path_n"] == 1 and lone["host_n"] == 301
    assert p[-4.0] < got["c", "x"]["host_p"] < mean


def test_features():
    f = dict(zip(Q.FEATURES, Q.text_features("Ab ab ab 12\n\n** é."), strict=True))
    assert f["upper"] == 1 / 6 and f["repeat_next"] == 1 / 6 and f["top_word"] == 2 / 6 and f["bare_word"] == 2 / 6
    assert Q.text_features(None) is None and Q.text_features(" \n\t") is None
    assert len(Q.text_features("x")) == len(Q.FEATURES)
    assert Q.text_features("same " * 300_000)[Q.FEATURES.index("top_word")] == 1.0


def test_edge_cases(spark):
    rows = [(i, f"This is plain text number {i} of some length.", "s", "en") for i in range(40)]
    rows += [(100 + i, "### $$$ %%% ### " * (3 + i % 5), "s", "en") for i in range(40)]
    rows += [(None, "This is plain text too, of some length.", None, None), (200, None, "s", None), (201, "", "t", "en"),
             (202, "### $$$ %%% " * 50_000, "s", "en"), (1, "This is plain text number 1 of some length.", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS host", "0.5 AS evidence")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)] + [(None, 0), (5, None), (3, 1)],
                                   "doc_id long, quality int")
    out = Q.score_documents(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in out.collect()}
    assert out.columns == [*docs.columns, "quality_score"] and out.count() == len(rows)
    assert all(got[i]["keep"] for i in range(40)) and not any(got[100 + i]["keep"] for i in range(40))
    assert got[None]["keep"] and not got[202]["keep"] and got[200]["evidence"] == got[201]["evidence"] == 0.0
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2
    assert Q.keep_good(docs, labels.where("quality = 1")).count() == len(rows)  # one class only: nothing to go by
    assert Q.keep_good(docs, labels.where("false")).count() == len(rows)
    assert Q.score_documents(docs.where("false"), labels).count() == 0


def test_filter_reads_every_text_once(spark):
    """The stage asks Python once for a text's evidence; the filter pushed below the
    join made a second evaluation, with a second worker in each task."""
    docs = spark.createDataFrame([(i, "plain text of words" if i % 2 else "### $$$", "s", "en") for i in range(20)],
                                 "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    plan = Q.keep_good(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
