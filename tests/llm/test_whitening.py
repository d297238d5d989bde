"""Whitening against numpy's dense eigenvectors, and its edge cases."""

import math

import numpy as np
import pytest

from versio.llm import whitening as W


def brute(rows, components=4, scale=256):
    """id -> (n, deviation, whitened up to sign, explained) by a dense covariance."""
    x = {i: tuple(math.floor(scale * float(np.float64(c))) for c in v) for i, v in rows
         if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(x.values())), float)
    n, sums = len(fit), [sum(int(v) for v in c) for c in fit.T]
    e, q = np.linalg.eigh((fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n)
    e, q = e[::-1], q[:, ::-1]
    return {i: (n, sum((n * int(c) - s) ** 2 for c, s in zip(v, sums)),
                np.abs((np.array(v) - np.array(sums) / n) @ q[:, :components] / np.sqrt(e[:components])), e[:components] / e.sum())
            for i, v in x.items()}


def got(df, **settings):
    out = {}
    for r in W.whiten(df, **settings).collect():
        out.setdefault(r["id"], {})[r["component"]] = r
    return out


def check(have, want):
    assert have.keys() == want.keys()
    for i, (n, deviation, white, explained) in want.items():
        assert sorted(have[i]) == list(range(1, len(white) + 1))
        for c, r in have[i].items():
            assert (r["n"], int(r["deviation"])) == (n, deviation)
            assert abs(r["whitened"]) == pytest.approx(white[c - 1], abs=1e-9)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert r["identity_error"] < 1e-10


def test_query_against_brute_force(spark):
    from versio.llm.queries import registry
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = registry()["op12_jacobi_davidson_whitening"][0](spark, sf)
    assert [(n, k) for n, k in out.dtypes][:7] == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double")]
    have = {}
    for r in out.withColumnRenamed("vec_id", "id").collect():
        have.setdefault(r["id"], {})[r["component"]] = r
    check(have, brute(rows))


def test_copies_odd_vectors_and_extra_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, rows[1][1])]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, whitening string")
    check(got(df.repartition(5)), brute(rows))
    assert len(got(df.unionByName(df.limit(3)))) == len(rows)
    assert got(df.where("vec_id >= 300")) == {} == got(df.where("false"))
    assert W.whiten(df.withColumn("vec_id", df["vec_id"].cast("string")).unionByName(
        df.selectExpr("cast(null as string) vec_id", "embedding", "whitening").limit(1))).where("id is null").count() == 4


def test_few_dimensions_no_variance_and_uneven_lengths(spark):
    two = [(i, [float(i), float(i * i)]) for i in range(9)]
    df = spark.createDataFrame(two, "vec_id long, embedding array<double>")
    check(got(df), brute(two))
    one = got(df.where("vec_id = 3"))[3]
    assert [r["whitened"] for r in one.values()] == [None, None] and {r["explained"] for r in one.values()} == {None}
    line = got(spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0 * i]) for i in range(5)], df.schema))
    assert [r["whitened"] is None for _, r in sorted(line[4].items())] == [False, True, True]
    uneven = spark.createDataFrame([(1, []), (2, [1.0]), (3, [1.0, 2.0])], df.schema)
    check(got(uneven), brute([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0])]))
    assert got(uneven.where("vec_id = 1")) == {}


def test_large_values_are_exact(spark):
    rows = [(i, [float(2 ** 40 + i), float(i % 3) * 2 ** 38]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    have, want = got(df), brute(rows)
    assert {i: int(v[1]["deviation"]) for i, v in have.items()} == {i: v[1] for i, v in want.items()}


def test_equal_eigenvalues():
    values, axes = W.jacobi_davidson(lambda b: b * np.array([5, 5, 5, 1, 1, 0, 0, 0.])[:, None], 8, 4)
    assert values == pytest.approx([5, 5, 5, 1]) and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12
    clustered = np.linspace(1, 2, 64)
    values, axes = W.jacobi_davidson(lambda b: b * clustered[:, None], 64, 6)
    assert values == pytest.approx(clustered[::-1][:6], rel=1e-13)
    assert np.linalg.norm(axes * clustered[:, None] - axes * values, axis=0).max() < 1e-12
