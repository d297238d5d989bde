"""Loss from scores in long form, and claims of output folders."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from versio.operators import losses as L
from versio.sources import files as FS

INF = float("inf")


@pytest.mark.parametrize("smoothing", [0.0, 0.1])
def test_long_scores_equal_the_dense_form(spark, smoothing):
    """Wide ranges over several bins, huge values, masked tokens, ignored labels."""
    rows = [(1, 0, [1.0, 2.0, 3.0], 2), (1, 1, [-2000.0, 900.0, 880.5, 511.9, 512.0], 3), (1, 2, [5.0, 5.0], 1), (2, 0, [1e300, 1e300, 0.0], 0),
            (2, 1, [-1e5, -1e5 - 1.0], 0), (3, 0, [0.25] * 7, 6), (3, 1, [511.999, 512.001, 0.0], 0), (4, 0, [1023.9, 512.1], 0)]
    if not smoothing:
        rows += [(5, 0, [-INF, 1.0, 2.0], 2), (5, 1, [3.0, INF], 0)]
    df = spark.createDataFrame(rows, "pair_id int, step int, z array<double>, label int")
    long = df.select("pair_id", "step", F.posexplode("z").alias("token_id", "score")).repartition(7)
    got = {(r[0], r[1]): r[2] for r in L.position_losses(long, df, smoothing=smoothing).collect()}
    want = {(r[0], r[1]): r[2] for r in df.where("label != 1").select("pair_id", "step", L.token_loss("z", "label", smoothing)).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-12) or got[k] == v or math.isnan(v) and math.isnan(got[k])
    one = L.cross_entropy_of_scores(long, df, smoothing=smoothing).first()
    assert one["tokens"] == len(want)


def test_label_without_a_score_is_an_error(spark):
    scores = spark.createDataFrame([(1, 0, 0, 1.0)], "pair_id int, step int, token_id int, score double")
    labels = spark.createDataFrame([(1, 0, 5), (1, 1, 0)], "pair_id int, step int, label int")
    with pytest.raises(Exception, match="no score for the label"):
        L.position_losses(scores, labels).collect()
    assert L.position_losses(scores, labels.where("step = 1")).count() == 0


def test_one_of_many_claims_a_folder(spark, scratch):
    """Sessions that all found the folder unused."""
    won, lost = [], []

    def start(i):
        try:
            FS.claim_output(spark, scratch)
            won.append(i)
        except FileExistsError:
            lost.append(i)

    threads = [threading.Thread(target=start, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert (len(won), len(lost)) == (1, 5)
    with pytest.raises(FileExistsError):
        FS.claim_output(spark, scratch)
    FS.claim_output(spark, scratch, resume=True)
