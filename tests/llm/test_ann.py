"""Nearest neighbours against brute force."""

import numpy as np

from versio.llm import ann as A


def brute(ids, x, queries, k):
    norms, out = np.sqrt((x * x).sum(axis=1)), {}
    for q in queries:
        s = (x * x[q]).sum(axis=1) / (norms * norms[q])
        best = sorted((-s[i], ids[i]) for i in range(len(x)) if ids[i] != ids[q])[:k]
        out[ids[q]] = [(i, -v) for v, i in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    """At least 0.9 of the true neighbours on the test vectors; scores exact."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is not None]
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    want = brute(ids, x, [i for i, v in enumerate(ids) if v % 50 == 0], 5)
    got = found(A.nearest(df.repartition(3), df.where("vec_id % 50 = 0")))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, near in got.items():
        true = x[ids.index(q)]
        for i, s in near:
            v = x[ids.index(i)]
            assert abs(s - float((v * true).sum() / (np.sqrt((v * v).sum()) * np.sqrt((true * true).sum())))) < 1e-12


def test_copies_and_clusters_are_exact(spark, monkeypatch):
    """Very many equal vectors, ties to the smaller id, several query passes."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.standard_normal(8), (300, 1)), rng.standard_normal((5, 8))[rng.integers(0, 5, 200)]
                        + 0.01 * rng.standard_normal((200, 8))])
    ids = [int(i) for i in rng.permutation(len(x))]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(A, "QUERY_BYTES", 256)
    got = found(A.nearest(df.repartition(4), df.where("vec_id % 50 = 0")))
    want = brute(ids, x, [n for n, i in enumerate(ids) if i % 50 == 0], 5)
    for q in want:
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in want[q]]
    tied = [q for q in want if want[q][0][1] > 1 - 1e-12]
    assert tied and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in tied)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.0]), (100, None), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS score")
    got = found(A.nearest(df, df.where("vec_id % 50 = 0")))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 50], 50: [1, 0]}
    assert A.nearest(df.where("false"), df).count() == 0 and A.nearest(df, df.where("false")).count() == 0
    assert A.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
