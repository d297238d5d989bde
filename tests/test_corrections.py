"""Ordinary inputs that once gave wrong results: one test each."""

import math

import pytest
from pyspark.sql import functions as F

from versio.operators import encoding as E
from versio.operators import hypotheses as Y
from versio.operators import inputs as I
from versio.operators import losses as L
from versio.operators import manifest as M
from versio.operators import metrics as X
from versio.operators import vocab as V
from versio.schemas import PREDICTIONS, SPECIAL_TOKENS, VOCAB
from versio.sources import files as FS


def _vocab(spark, n):
    rows = [("xx", t, i) for i, t in enumerate(SPECIAL_TOKENS)] + [("xx", f"t{i}", i + 4) for i in range(n)]
    return spark.createDataFrame(rows, VOCAB)


def test_predictions_keep_every_text(spark, scratch):
    rows = [("  a b ", "x ", "\ty"), ("\\N", "", "q\"uote\n,line"), ("n", "\\", "")]
    FS.write_predictions(spark.createDataFrame(rows, PREDICTIONS), scratch)
    assert sorted(tuple(r) for r in FS.read_predictions(spark, scratch).collect()) == sorted(rows)


def test_half_written_vocabulary_is_replaced(spark, scratch):
    split = spark.createDataFrame([("train", "a a b b")], "split string, t string")
    _vocab(spark, 2).write.parquet(f"{scratch}/_temporary")  # what a stopped write leaves behind
    assert V.load_or_train_vocab(spark, scratch, split, {"xx": "t"}).count() == 6
    spark.createDataFrame([("xx", "a", 9)], VOCAB).write.parquet(f"{scratch}-bad")
    with pytest.raises(ValueError, match="special"):
        V.load_or_train_vocab(spark, f"{scratch}-bad", split, {"xx": "t"})


def test_large_vocabulary_with_its_cap(spark):
    df = spark.createDataFrame([(1, "t39999 t1 other"), (2, None)], "id long, t string")
    vocab = _vocab(spark, 40_000)
    with pytest.raises(ValueError, match="bound"):
        E.encode_ids(df, ["id"], {"s": ("t", "xx")}, vocab)
    enc = E.encode_ids(df, ["id"], {"s": ("t", "xx")}, vocab, cap=40_004)
    assert {r.id: r.s for r in enc.collect()} == {1: [40_003, 5, 0], 2: []}
    dec = E.decode_texts(enc, ["id"], "s", vocab, "xx", cap=40_004)
    assert {r.id: r.text for r in dec.collect()} == {1: "t39999 t1", 2: ""}


def test_null_text_goes_to_the_quarantine(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, "a " * 50, "b")], "id long, src_text string, tgt_text string")
    assert [r.id for r in I.length_filter(df, 10).collect()] == [2]
    assert {r.id: r.reason for r in I.overlong_quarantine(df, 10).collect()} == {1: "null_text", 3: "overlong"}


def test_masked_logits(spark):
    inf = float("inf")
    rows = [[-inf, 1.0], [1.0, -inf], [-inf, -inf], [0.0, 0.0], [inf, 1.0], [inf, inf], [-inf, 2.0, 2.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, z array<double>")
    got = [r.v for r in df.select("i", L.log_sum_exp("z").alias("v")).orderBy("i").collect()]
    assert got == [1.0, 1.0, -inf, pytest.approx(math.log(2)), inf, inf, pytest.approx(2 + math.log(2))]
    loss = df.where("i = 0").select(L.token_loss("z", F.lit(1), 0.0).alias("v")).first().v
    assert loss == 0.0


def test_repeated_ids_stay_pairs_of_their_own(spark):
    rows = [(7, "a b c d", "a b c d"), (7, "e f g h", "i j k l")]
    df = spark.createDataFrame(rows, "id long, h string, r string")
    assert X.bleu(df, ["id"], "h", "r").first().bleu == pytest.approx(0.5)
    pairs = spark.createDataFrame([(7, 1, "s1", "r1", [4]), (7, 2, "s2", "r2", [5])],
                                  "id long, row_key int, src_text string, tgt_text string, hypothesis array<int>")
    got = Y.prediction_table(pairs.drop("hypothesis"), pairs.select("id", "row_key", "hypothesis"), _vocab(spark, 2), "xx")
    assert sorted((r.source, r.prediction) for r in got.collect()) == [("s1", "t0"), ("s2", "t1")]


def test_results_are_of_the_run_asked_for(spark):
    best = spark.createDataFrame([("r1", 3, 1.0), ("r2", 7, 0.5)], "run_id string, best_epoch int, best_val_loss double")
    scores = spark.createDataFrame([(0.1, 0.2, 0.3, 4)], "bleu double, cer double, wer double, decoded_test_examples long")
    loss = spark.createDataFrame([(1.5,)], "loss double")
    for run, epoch in (("r1", 3), ("r2", 7)):
        assert X.test_results(loss, scores, spark.range(9), best, run).first().best_epoch == epoch


def test_a_key_that_only_one_manifest_has_differs(spark):
    rows = [("base", "split_seed", "1"), ("base", "source", "a"), ("c", "source", "a"), ("c", "software", "x")]
    diff = M.manifest_diff(spark.createDataFrame(rows, "run_id string, key string, value string"), "base")
    assert {r.key: r.severity for r in diff.collect()} == {"split_seed": "block", "source": "same", "software": "warn"}


def test_history_export_keeps_runs(spark, scratch):
    rows = [("r1", 1, 0.5, 0.6, 2.0, 3), ("r2", 1, 0.4, 0.3, 2.0, 3)]
    h = spark.createDataFrame(rows, "run_id string, epoch int, train_loss double, val_loss double, seconds double, global_step int")
    FS.export_history_csv(h, scratch)
    assert sorted(tuple(r) for r in FS.read_history(spark, scratch).collect()) == rows
    with pytest.raises(Exception, match="(?i)exist"):
        FS.export_history_csv(h, scratch)


def test_changed_corpus_of_the_same_counts_is_another_source(spark):
    rows = [(1, ("a", "b")), (2, ("c", "d"))]
    kind = "id long, translation struct<en:string,it:string>"
    one = M.corpus_digest(spark.createDataFrame(rows, kind))
    assert one == M.corpus_digest(spark.createDataFrame(rows[::-1], kind).repartition(3))
    assert one != M.corpus_digest(spark.createDataFrame([(1, ("a", "b")), (2, ("c", "e"))], kind))
