import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from versio.functions import arrays as A
from versio.operators import history as H
from versio.operators import losses as L
from versio.operators.inputs import assert_lengths, length_filter, length_filter_report, model_inputs


def test_smoke_arrays(spark):
    df = spark.createDataFrame([(1, [4, 6, 7], [4, 8, 6])], "id long, src_ids array<int>, tgt_ids array<int>")
    r = df.select(A.encoder_input("src_ids", 8).alias("e"), A.decoder_input("tgt_ids", 8).alias("d"),
                  A.label("tgt_ids", 8).alias("l"), A.encoder_mask(A.encoder_input("src_ids", 8)).alias("m"),
                  A.decoder_mask(A.decoder_input("tgt_ids", 8), 8).alias("dm")).first()
    assert r.e == [2, 4, 6, 7, 3, 1, 1, 1]
    assert r.d == [2, 4, 8, 6, 1, 1, 1, 1]
    assert r.l == [4, 8, 6, 3, 1, 1, 1, 1]
    assert r.m == [1, 1, 1, 1, 1, 0, 0, 0]
    want = [[int(j <= i and r.d[j] != 1) for j in range(8)] for i in range(8)]
    assert r.dm == want


def test_label_is_decoder_input_shifted(spark):
    df = spark.createDataFrame([(i, list(range(4, 4 + i))) for i in range(0, 7)], "id long, t array<int>")
    for r in df.select(A.decoder_input("t", 8).alias("d"), A.label("t", 8).alias("l"), "t").collect():
        n = len(r.t)
        assert r.d[1:n + 1] == r.l[:n] and r.l[n] == 3 and len(r.d) == len(r.l) == 8


def test_length_filter_and_overlong_error(spark):
    df = spark.createDataFrame([(1, "train", "a b c", "x y"), (2, "val", "a b c d e f g", "x"),
                                (3, "test", "a", "x y z w v u t s")],
                               "id long, split string, src_text string, tgt_text string")
    assert [r.id for r in length_filter(df, 8).collect()] == [1]
    rep = {r.split: (r.rows_before, r.rows_after) for r in length_filter_report(df, 8).collect()}
    assert rep == {"train": (1, 1), "val": (1, 0), "test": (1, 0)}
    enc = df.select("id", F.split("src_text", " ").alias("a"), F.split("tgt_text", " ").alias("b"))
    enc = enc.select("id", F.transform("a", lambda x: F.lit(5)).alias("src_ids"),
                     F.transform("b", lambda x: F.lit(5)).alias("tgt_ids"),
                     F.lit("s").alias("src_text"), F.lit("t").alias("tgt_text"))
    ok = model_inputs(enc.where("id = 1"), 8, extra_cols=())
    assert assert_lengths(ok, 8).first().bad_rows == 0
    with pytest.raises(Exception, match="more tokens than the sequence length"):
        model_inputs(enc, 8, extra_cols=()).collect()


def _np_loss(z, y, eps):
    z = np.asarray(z, dtype=np.float64)
    lse = z.max() + math.log(np.exp(z - z.max()).sum())
    return (1 - eps) * (lse - z[y]) + eps * (lse - z.mean())


def test_token_loss_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 5, 40)], int(rng.integers(0, 40))) for i in range(50)]
    rows.append((99, [1000.0, 999.0, -1000.0], 0))
    df = spark.createDataFrame(rows, "i long, z array<double>, y int")
    got = {r.i: r.loss for r in df.select("i", L.token_loss("z", "y", 0.1).alias("loss")).collect()}
    for i, z, y in rows:
        assert got[i] == pytest.approx(_np_loss(z, y, 0.1), rel=1e-12)
    ce = L.cross_entropy(df, "z", "y", 0.0).first()
    keep = [(z, y) for _, z, y in rows if y != 1]
    assert ce.tokens == len(keep)
    assert ce.loss == pytest.approx(np.mean([_np_loss(z, y, 0.0) for z, y in keep]), rel=1e-12)


def test_epoch_and_running_loss(spark):
    rows = [("r", 1, "train", b, float(b % 5 + 1), b % 3 + 1) for b in range(40)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, phase string, batch_id long, loss double, tokens long")
    e = L.epoch_loss(df).first()
    assert e.batches == 40
    assert e.epoch_loss == pytest.approx(sum(r[4] * r[5] for r in rows) / sum(r[5] for r in rows))
    run = {r.batch_id: r.running_loss for r in L.running_loss(df).collect()}
    num = den = 0
    for r in rows:
        num += r[4] * r[5]
        den += r[5]
        assert run[r[3]] == pytest.approx(num / den)


# The recorded six-epoch demo history (epoch, train, val, seconds, step).
DEMO_HISTORY = [
    (1, 6.694250522957315, 6.32285729993611, 3.58, 47),
    (2, 6.31227735468347, 5.999580216861701, 3.44, 94),
    (3, 6.058919006039963, 5.752089897719493, 3.26, 141),
    (4, 5.852038895646392, 5.541314392660492, 3.3, 188),
    (5, 5.667146882145889, 5.363855422029469, 3.16, 235),
    (6, 5.517833934434424, 5.219174156811491, 3.2, 282),
]


def test_history_golden(spark):
    hist = spark.createDataFrame([("demo", *r) for r in DEMO_HISTORY],
                                 "run_id string, epoch int, train_loss double, val_loss double, "
                                 "seconds double, global_step int")
    assert H.best_epoch(hist).first().best_epoch == 6
    prog = H.with_progress(hist).orderBy("epoch").collect()
    assert all(r.improved for r in prog)
    assert [r.best_so_far for r in prog] == [r[2] for r in DEMO_HISTORY]
    res = H.resume_point(hist).first()
    assert (res.next_epoch, res.global_step) == (7, 282)
    steps = hist.withColumn("train_batches", F.lit(47))
    assert [r.global_step for r in H.global_step(steps).orderBy("epoch").collect()] == [47 * i for i in range(1, 7)]
    curve = H.learning_curve(hist).where("is_best").collect()
    assert [(r.epoch, r.series) for r in curve] == [(6, "val")]


def test_best_epoch_first_on_ties_and_not_improved(spark):
    hist = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 1.0, 1.5), ("a", 3, 1.0, 1.5), ("a", 4, 1.0, 1.7)],
                                 "run_id string, epoch int, train_loss double, val_loss double")
    assert H.best_epoch(hist).first().best_epoch == 2
    assert [r.improved for r in H.with_progress(hist).orderBy("epoch").collect()] == [True, True, False, False]


def test_history_analytics_keep_runs_apart(spark):
    rows = [("a", 1, 2.0, 3.0, 1.0, 10), ("a", 2, 1.5, 2.0, 1.0, 20), ("a", 3, 1.2, 2.5, 1.0, 30),
            ("b", 1, 9.0, 1.0, 1.0, 5), ("b", 2, 8.0, 4.0, 1.0, 10)]
    hist = spark.createDataFrame(rows, "run_id string, epoch int, train_loss double, val_loss double, "
                                       "seconds double, global_step int")
    best = {r.run_id: r.best_epoch for r in H.best_epoch(hist).collect()}
    assert best == {"a": 2, "b": 1}
    prog = {(r.run_id, r.epoch): (r.best_so_far, r.improved) for r in H.with_progress(hist).collect()}
    assert prog[("b", 1)] == (1.0, True) and prog[("b", 2)] == (1.0, False)
    assert prog[("a", 3)] == (2.0, False)
    res = {r.run_id: (r.next_epoch, r.global_step) for r in H.resume_point(hist).collect()}
    assert res == {"a": (4, 30), "b": (3, 10)}
    curve = {(r.run_id, r.epoch, r.series) for r in H.learning_curve(hist).where("is_best").collect()}
    assert curve == {("a", 2, "val"), ("b", 1, "val")}
