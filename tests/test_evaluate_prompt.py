import pytest
from pyspark.sql import functions as F

from versio.operators.inputs import prompt_input
from versio.plans.evaluate import echo_model, evaluate
from versio.plans.prepare import prepare
from versio.sources.pairs import load_fixture_pairs

SF001 = "/root/testdata/sf0.001"


def test_evaluate_first_rows_in_split_order(spark):
    p = prepare(load_fixture_pairs(spark, SF001), seed=42, seq_len=256, with_decoder_mask=False)
    test_ids = [r.id for r in p.encoded.where("split = 'test'").orderBy("split_key").collect()]
    predictions, scores = evaluate(p, echo_model, 256, 2)
    rows = predictions.collect()
    assert sorted(r.id for r in rows) == sorted(test_ids[:2])
    s = scores.first()
    assert s.decoded_test_examples == min(2, len(test_ids)) and 0.0 <= s.cer and 0.0 <= s.wer
    all_rows, _ = evaluate(p, echo_model, 256, 0)
    assert all_rows.count() == len(test_ids)


def test_prompt_input_pads_and_rejects_overlong(spark):
    p = prepare(load_fixture_pairs(spark, SF001), seed=42, seq_len=256, with_decoder_mask=False)
    texts = spark.createDataFrame([(1, "the cat"), (2, " ".join(["word"] * 20))], "id long, text string")
    ok = prompt_input(texts.where("id = 1"), ["id"], "text", p.vocab, "en", 8).first()
    assert len(ok.encoder_input) == 8 and ok.encoder_input[0] == 2 and ok.encoder_input[3] == 3
    assert ok.encoder_mask == [1, 1, 1, 1, 0, 0, 0, 0]
    with pytest.raises(Exception, match="more tokens than the sequence length"):
        prompt_input(texts, ["id"], "text", p.vocab, "en", 8).select(F.col("encoder_input")).collect()
