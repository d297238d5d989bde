"""Classifier chain: held-out accuracy, the chain itself, and edge cases."""

import random

import numpy as np

from versio.llm import toxicity as T
from versio.llm.queries import toxic_labels


def test_held_out_toxic_documents(spark):
    """Trained without a fifth of the labels, the chain finds the toxic ones there."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = toxic_labels(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    out = T.toxicity(docs, labels.where("doc_id % 5 != 0"), ["toxic", "insult", "contempt"])
    rows = out.join(labels.where("doc_id % 5 = 0"), "doc_id").select("toxic", "toxicity.toxic").toDF("label", "p").collect()
    caught = [r["p"] >= 0.5 for r in rows if r["label"]]
    false = [r["p"] >= 0.5 for r in rows if not r["label"]]
    assert len(caught) > 50 and np.mean(caught) >= 0.9 and np.mean(false) <= 0.01


def test_later_models_use_earlier_probabilities():
    """The second label follows the first one and not the features: only the
    chain can see it, and its training inputs are out-of-fold."""
    rng = np.random.default_rng(1)
    x = (rng.random((600, 6)) < 0.5).astype(np.float32)
    first = (x[:, 0] + x[:, 1] + x[:, 2] >= 2).astype(int)
    labels = np.stack([first, first, np.ones(600, int)], axis=1)
    models = T.fit_chain(x, labels, np.arange(600) % 3)
    assert [len(m) for m in models] == [7, 8, 9]
    assert models[1][6] > 0.5  # the weight of the earlier probability
    p = T.run_chain(x.astype(float), models)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.95 and ((p[:, 1] > 0.5) == first).mean() > 0.95 and (p[:, 2] > 0.99).all()


def test_logistic_matches_newton():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2, -1, 0.5])))).astype(float)
    z, w = np.hstack([x, np.ones((400, 1))]), np.zeros(4)
    pen = np.array([1e-3] * 3 + [0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / 400 + np.diag(pen), z.T @ (p - y) / 400 + pen * w)
    assert np.allclose(T.fit_logistic(x, y, 1e-3, 6000), w, atol=2e-2)


def test_edge_cases(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["good", "fine", "plain", "words"], k=9)) + (" awful" if i % 4 == 0 else ""), int(i % 4 == 0))
            for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "1 AS toxic", "'x' AS toxicity_2")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 1), (0, 1, None), (900, 1, 0)],
                                   "doc_id long, toxic int, none int")
    extra = spark.createDataFrame([(None, "awful", 1, "x"), (200, None, 1, "x"), (201, "", 1, "x"), (202, "x " * 300_000 + "awful", 1, "x"),
                                   (202, "x " * 300_000 + "awful", 1, "x")], docs.schema)
    out = T.toxicity(docs.union(extra), labels, ["toxic", "none"])
    got = {r["doc_id"]: r["toxicity"] for r in out.collect()}
    assert out.count() == 85 and out.columns == [*docs.columns, "toxicity"]
    assert all((got[r[0]]["toxic"] > 0.5) == bool(r[2]) for r in rows) and max(v["none"] for v in got.values()) < 1e-6
    assert got[None]["toxic"] > 0.5 and got[202]["toxic"] > 0.5 and got[200]["toxic"] == got[201]["toxic"] == 0.0
    assert T.toxicity(docs, labels.where("false"), ["toxic"]).first()["toxicity"]["toxic"] == 0.0
    assert T.toxicity(docs.where("false"), labels, ["toxic"]).count() == 0


def test_counts_of_long_texts_are_whole():
    """No bound on how often an n-gram is counted, also over block ends."""
    from versio.llm import toxicity as TX
    bucket = int(next(TX.grams("idiot"))[1])  # the word with the space before it is [0]
    column = np.full(TX.BUCKETS, -1, np.int16)
    column[bucket] = 0
    assert TX.gram_counts("idiot " * 1000, column, 1)[0] == 1000
