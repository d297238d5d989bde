import pytest
from pyspark.sql import functions as F

from versio.operators.losses import epoch_loss
from versio.plans.fixtures import batch_losses
from versio.schemas import BATCH_LOSS
from versio.streaming.epoch_stream import latest_epoch_losses, start_epoch_history

SF001 = "/root/testdata/sf0.001"


def test_stream_equals_batch_epoch_loss(spark, scratch):
    batches = batch_losses(spark, SF001).select(*[f.name for f in BATCH_LOSS.fields])
    inbox = f"{scratch}/inbox"
    batches.where(F.col("epoch") <= 10).write.parquet(f"{inbox}/part1")
    q = start_epoch_history(spark, f"{inbox}/*", f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination(120)
    batches.where(F.col("epoch") > 10).write.parquet(f"{inbox}/part2")
    q = start_epoch_history(spark, f"{inbox}/*", f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination(120)
    got = {(r.run_id, r.epoch, r.phase): (r.epoch_loss, r.batches) for r in latest_epoch_losses(spark, f"{scratch}/out").collect()}
    want = {(r.run_id, r.epoch, r.phase): (r.epoch_loss, r.batches) for r in epoch_loss(batches).collect()}
    assert got.keys() == want.keys()
    for k, (loss, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(loss, rel=1e-12)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry_mod

    df = entry_mod.entry(spark)
    rows = df.collect()
    assert rows and all(len(r.encoder_input) == 256 for r in rows)
    assert {r.split for r in rows} == {"train", "val", "test"}
    names = set(entry_mod.queries())
    assert set(entry_mod.oracle_sql()) <= names
    assert len(names) >= 60


def test_progress_stream_matches_batch_and_ignores_replays(spark, scratch):
    from versio.operators.history import epoch_summary, with_progress
    from versio.streaming.progress_stream import HISTORY_ROWS, start_progress

    hist = epoch_summary(batch_losses(spark, SF001)).select(*[f.name for f in HISTORY_ROWS.fields])
    inbox = f"{scratch}/inbox"
    hist.where(F.col("epoch") <= 10).write.parquet(f"{inbox}/a")
    start_progress(spark, f"{inbox}/*", f"{scratch}/out", f"{scratch}/ckpt").awaitTermination(120)
    hist.where(F.col("epoch") > 10).write.parquet(f"{inbox}/b")
    hist.where(F.col("epoch") <= 5).write.parquet(f"{inbox}/replayed")  # re-delivered epochs
    start_progress(spark, f"{inbox}/*", f"{scratch}/out", f"{scratch}/ckpt").awaitTermination(120)
    got = {(r.run_id, r.epoch): (r.best_so_far, r.improved) for r in spark.read.parquet(f"{scratch}/out").collect()}
    want = {(r.run_id, r.epoch): (r.best_so_far, r.improved) for r in with_progress(hist).collect()}
    assert got == want
    assert spark.read.parquet(f"{scratch}/out").count() == hist.count()


def test_late_epochs_are_emitted(spark, scratch):
    from versio.streaming.progress_stream import HISTORY_ROWS, start_progress

    inbox = f"{scratch}/inbox"
    for i, (epoch, loss) in enumerate([(2, 0.5), (1, 0.4), (1, 0.4), (3, 0.45)]):
        spark.createDataFrame([("r", epoch, 1.0, loss, 1.0, 1)], HISTORY_ROWS).write.parquet(f"{inbox}/d{i}")
        start_progress(spark, f"{inbox}/*", f"{scratch}/out", f"{scratch}/ckpt").awaitTermination(120)
    got = sorted((r.epoch, r.best_so_far, r.improved, r.status) for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == [(1, 0.4, True, "late"), (2, 0.5, True, "in_order"), (3, 0.4, False, "in_order")]


def test_task_side_functions_ship_by_value():
    import json

    from pyspark import cloudpickle

    from versio.plans.evaluate import echo_model
    from versio.streaming import progress_stream

    by_reference = len(cloudpickle.dumps(json.dumps))  # an importable library function: a name only
    for fn in (progress_stream._advance, echo_model):
        payload = cloudpickle.dumps(fn)
        assert len(payload) > 5 * by_reference  # carries its code, not an import of this package
        assert cloudpickle.loads(payload).__name__ == fn.__name__
