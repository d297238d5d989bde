import pytest

from versio.plans.experiment import prepare_run
from versio.sources.pairs import load_fixture_pairs

SF001 = "/root/testdata/sf0.001"


def test_run_folder_resume_gate(spark, scratch):
    pairs = load_fixture_pairs(spark, SF001)
    prepared, manifest = prepare_run(spark, pairs, scratch, seed=42, seq_len=256)
    m = manifest.first()
    assert (m.selected_examples, m.split_before_filter.train, m.split_before_filter.test) == (34, 28, 3)
    assert spark.read.parquet(f"{scratch}/model_inputs").count() == prepared.inputs.count()
    with pytest.raises(FileExistsError):
        prepare_run(spark, pairs, scratch, seed=42, seq_len=256)
    prepare_run(spark, pairs, scratch, seed=42, seq_len=256, resume=True)
    with pytest.warns(UserWarning):
        prepare_run(spark, pairs, scratch, seed=42, seq_len=256, resume=True, software={"pyspark": "0"})
    with pytest.raises(ValueError, match="cannot resume"):
        prepare_run(spark, pairs, scratch, seed=7, seq_len=256, resume=True)
