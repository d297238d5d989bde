import hashlib
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from versio.operators import manifest as M
from versio.operators import metrics as X
from versio.operators.hypotheses import argmax_dense, assemble_hypotheses, greedy_pick, truncate_hypothesis
from versio.sources import files as FS
from versio.sources.pairs import load_fixture_pairs

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def _ed(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def _bleu(hyps, refs):
    clipped, total = [0] * 4, [0] * 4
    c = r = 0
    for h, ref in zip(hyps, refs):
        hw, rw = h.split(), ref.split()
        c, r = c + len(hw), r + len(rw)
        for n in range(1, 5):
            hc = Counter(tuple(hw[i:i + n]) for i in range(len(hw) - n + 1))
            rc = Counter(tuple(rw[i:i + n]) for i in range(len(rw) - n + 1))
            clipped[n - 1] += sum(min(v, rc[k]) for k, v in hc.items())
            total[n - 1] += sum(hc.values())
    if min(clipped) == 0:
        return 0.0
    bp = 1.0 if c > r else math.exp(1 - r / c)
    return bp * math.exp(sum(math.log(x / t) / 4 for x, t in zip(clipped, total)))


def test_metrics_against_brute_force_on_conversations(spark):
    p = load_fixture_pairs(spark, SF001)
    pairs = p.select("id", F.col("translation.en").alias("hyp"), F.col("translation.it").alias("ref"))
    rows = pairs.collect()
    errs = {r.id: r for r in X.sentence_errors(pairs, ["id"], "hyp", "ref").collect()}
    for r in rows:
        assert errs[r.id].char_errors == _ed(r.hyp, r.ref)
        assert errs[r.id].word_errors == _ed(r.hyp.split(), r.ref.split())
        assert errs[r.id].ref_words == len(r.ref.split())
    want_wer = sum(_ed(r.hyp.split(), r.ref.split()) for r in rows) / sum(len(r.ref.split()) for r in rows)
    assert X.wer(pairs, "hyp", "ref").first().wer == pytest.approx(want_wer)
    want_cer = sum(_ed(r.hyp, r.ref) for r in rows) / sum(len(r.ref) for r in rows)
    assert X.cer(pairs, "hyp", "ref").first().cer == pytest.approx(want_cer)
    mixed = pairs.select("id", F.concat_ws(" ", "ref", "hyp").alias("hyp"), "ref")
    mrows = mixed.collect()
    assert X.bleu(mixed, ["id"], "hyp", "ref").first().bleu == pytest.approx(
        _bleu([r.hyp for r in mrows], [r.ref for r in mrows]))


def test_metric_identities_and_empty_predictions(spark):
    refs = ["la vita pareva tale , quale migliore", "egli la guardò con uno sguardo tenero", "parlate e non"]
    same = spark.createDataFrame([(i, t, t) for i, t in enumerate(refs)], "id long, hyp string, ref string")
    s = X.corpus_scores(same, ["id"], "hyp", "ref").first()
    assert (s.bleu, s.cer, s.wer) == (pytest.approx(1.0), 0.0, 0.0)
    empty = spark.createDataFrame([(i, "", t) for i, t in enumerate(refs)], "id long, hyp string, ref string")
    e = X.corpus_scores(empty, ["id"], "hyp", "ref").first()
    assert (e.bleu, e.cer, e.wer, e.decoded_test_examples) == (0.0, 1.0, 1.0, 3)


def test_hypotheses(spark):
    scores = spark.createDataFrame([(1, 0, 5, 0.5), (1, 0, 4, 0.5), (1, 0, 9, 0.1), (1, 1, 3, 2.0), (1, 2, 7, 9.0)],
                                   "pair_id long, step long, token_id int, score double")
    picks = greedy_pick(scores)
    assert sorted((r.step, r.token_id) for r in picks.collect()) == [(0, 4), (1, 3), (2, 7)]
    h = assemble_hypotheses(picks, 10).first().hypothesis
    assert h == [2, 4, 3]
    df = spark.createDataFrame([([5, 6, 7, 8],), ([3],), ([],)], "p array<int>")
    assert [r.t for r in df.select(truncate_hypothesis("p", 3).alias("t")).collect()] == [[2, 5, 6], [2, 3], [2]]
    dense = spark.createDataFrame([([0.1, 0.9, 0.9, 0.2],)], "z array<double>")
    assert dense.select(argmax_dense("z").alias("a")).first().a == 1


def test_manifest_diff_severity(spark):
    rows = [("base", "split_seed", "42"), ("base", "software", "a"), ("base", "dataset_fingerprint", "x"),
            ("new", "split_seed", "43"), ("new", "software", "b"), ("new", "dataset_fingerprint", "y"),
            ("same", "split_seed", "42"), ("same", "software", "a"), ("same", "dataset_fingerprint", "z")]
    long = spark.createDataFrame(rows, "run_id string, key string, value string")
    diff = {(r.run_id, r.key): r.severity for r in M.manifest_diff(long, "base").collect()}
    assert diff[("new", "split_seed")] == "block" and diff[("new", "software")] == "warn"
    assert diff[("new", "dataset_fingerprint")] == "ignored" and diff[("same", "split_seed")] == "same"
    gate = {r.run_id: r.resume_allowed for r in M.resume_allowed(M.manifest_diff(long, "base")).collect()}
    assert gate == {"new": False, "same": True}


def test_checksums_equal_hashlib(spark):
    got = {r.name: r.sha256 for r in FS.file_digests(spark, SF001, "*.parquet").collect()}
    for name in ("region.parquet", "conversations.parquet"):
        with open(os.path.join(SF001, name), "rb") as fh:
            assert got[name] == hashlib.sha256(fh.read()).hexdigest()
    report = FS.verify_checksum(spark, SF001, {"region.parquet": "0" * 64}, "region.parquet")
    assert report.first().status == "mismatch"


def test_predictions_csv_keeps_empty_apart_from_null(spark, scratch):
    rows = [("a \"quoted\"\nline", "ref, with comma", ""), ("x", "y", None)]
    df = spark.createDataFrame(rows, "source string, reference string, prediction string")
    FS.write_predictions(df, scratch)
    back = sorted(FS.read_predictions(spark, scratch).collect(), key=lambda r: r.source)
    assert [tuple(r) for r in back] == [("a \"quoted\"\nline", "ref, with comma", ""), ("x", "y", "")]
    with pytest.raises(Exception):
        FS.write_predictions(df, scratch)
    with pytest.raises(FileExistsError):
        FS.ensure_new_output(spark, scratch)


def test_pairs_adapter_counts(spark):
    assert load_fixture_pairs(spark, SF01).count() == 233


def test_empty_history_is_an_error_and_unpinned_files_are_reported(spark, scratch):
    from versio.schemas import HISTORY

    spark.createDataFrame([], HISTORY).coalesce(1).write.options(header="true").csv(scratch)
    with pytest.raises(ValueError, match="no epochs"):
        FS.read_history(spark, scratch)
    report = FS.verify_checksum(spark, SF001, {}, "region.parquet")
    assert [r.status for r in report.collect()] == ["unpinned"]
