"""History files by column name, appends that may be repeated, file digests."""

import hashlib
import os
import threading

import pytest

from versio.sources import appends as AP
from versio.sources import files as FS
from versio.sources.histories import checked_history
from versio.streaming.epoch_stream import latest_epoch_losses, start_epoch_history

HIST = "run_id string, epoch int, train_loss double, val_loss double, seconds double, global_step int"


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_columns_are_found_by_name(spark, scratch):
    """Files with different orders, extra columns and a byte order mark; seconds absent in one."""
    put(scratch, "a.csv", "epoch,val_loss,train_loss,note,global_step,seconds\n1,5.0,6.0,\"x, y\",47,3.5\n")
    put(scratch, "b c.csv", "﻿val_loss,epoch,train_loss\n4.5,2,5.5\n\\N,3,nan\n")
    rows = sorted(tuple(r) for r in FS.read_history(spark, scratch).select("epoch", "train_loss", "val_loss", "seconds", "global_step").collect())
    assert rows[:2] == [(1, 6.0, 5.0, 3.5, 47), (2, 5.5, 4.5, None, None)]
    assert rows[2][0] == 3 and rows[2][1] != rows[2][1] and rows[2][2] is None


@pytest.mark.parametrize(("line", "problem"), [
    ("2,abc,5.0,3.0,94", "train_loss is 'abc'"), ("2,5.5,5.0,3.0", "not as many cells"), ("2,5.5,5.0,3.0,94,7", "not as many cells"),
    (",5.5,5.0,3.0,94", "epoch is empty"), ("2,5.5,,3.0,94", "val_loss is empty"), ("2.5,5.5,5.0,3.0,94", "epoch is '2.5'"),
    ("\\N,5.5,5.0,3.0,94", "epoch is")])
def test_broken_rows_are_errors_or_set_aside(spark, scratch, line, problem):
    put(scratch, "h.csv", f"epoch,train_loss,val_loss,seconds,global_step\n1,6.0,5.0,3.5,47\n{line}\n")
    with pytest.raises(ValueError, match="broken rows"):
        FS.read_history(spark, scratch)
    good, bad = checked_history(spark, scratch)
    assert [tuple(r) for r in good.collect()] == [(1, 6.0, 5.0, 3.5, 47)]
    assert [problem in r["problem"] for r in bad.collect()] == [True]


def test_header_without_a_needed_column(spark, scratch):
    put(scratch, "h.csv", "epoch,train_loss,seconds\n1,2.0,3.0\n")
    with pytest.raises(ValueError, match="val_loss"):
        FS.read_history(spark, scratch)
    put(scratch, "h.csv", "epoch,train_loss,val_loss\n")
    with pytest.raises(ValueError, match="no epochs"):
        FS.read_history(spark, scratch)


def read(spark, path):
    return sorted(tuple(r) for r in FS.read_history(spark, path, "parquet").collect())


def test_appends_may_be_repeated(spark, scratch):
    rows = [("r1", e, float(e), e / 2, 1.0, 47 * e) for e in range(1, 5)] + [("r2", 1, 9.0, None, 1.0, 3)]
    df = spark.createDataFrame(rows, HIST)
    assert FS.append_history(df.where("epoch <= 3"), scratch)
    for _ in range(2):
        FS.append_history(df.where("epoch >= 2"), scratch)
    assert read(spark, scratch) == rows
    # another value for an epoch replaces it
    FS.append_history(spark.createDataFrame([("r1", 4, 1.0, 1.5, 1.0, 188)], HIST), scratch)
    assert read(spark, scratch)[3] == ("r1", 4, 1.0, 1.5, 1.0, 188)
    with pytest.raises(ValueError, match="same epoch"):
        FS.append_history(spark.createDataFrame([rows[0], ("r1", 1, 0.0, 0.0, 0.0, 0)], HIST), scratch)


def test_key_crash_and_compaction(spark, scratch, monkeypatch):
    one = spark.createDataFrame([("r", 1, 1.0, 1.0, 1.0, 1)], HIST)
    two = spark.createDataFrame([("r", 2, 2.0, 2.0, 1.0, 2)], HIST)
    assert FS.append_history(one, scratch, key="k1") and not FS.append_history(two, scratch, key="k1")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(AP, "publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            FS.append_history(two, scratch, key="k2")
    assert len(read(spark, scratch)) == 1  # written, never entered
    assert FS.append_history(two, scratch, key="k2")
    FS.compact_history(spark, scratch)
    assert not FS.append_history(one, scratch, key="k1")
    assert FS.append_history(spark.createDataFrame([("r", 2, 7.0, 7.0, 1.0, 2)], HIST), scratch)
    FS.compact_history(spark, scratch)
    assert [r[2] for r in read(spark, scratch)] == [1.0, 7.0]
    assert len(AP._live(AP.log_entries(spark, scratch))) == 1


def test_compaction_keeps_what_comes_meanwhile(spark, scratch):
    """An append after a compaction's read, and a compaction that read less."""
    log = [{"n": 1, "append": "a", "key": None}, {"n": 2, "append": "b", "key": None},
           {"n": 3, "append": "c", "key": None, "upto": 2, "held": []}, {"n": 4, "append": "d", "key": None},
           {"n": 5, "append": "e", "key": None, "upto": 1, "held": []}]
    assert [e["append"] for e in AP._live(log)] == ["c", "d"]


def test_two_writers_take_different_numbers(spark, scratch):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(AP.publish(spark, f"{scratch}/_log/1", str(i)))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True]
    assert AP.read_text(spark, f"{scratch}/_log/1") in "01234567"


def test_replayed_micro_batch_counts_once(spark, scratch):
    batch = spark.createDataFrame([("r", 1, "train", 10.0, 5, 2)],
                                  "run_id string, epoch int, phase string, loss_tokens double, tokens long, batches long")
    for _ in range(2):
        AP.append_rows(batch, scratch, key="ckpt 0")
    assert len(AP.log_entries(spark, scratch)) == 1
    assert [tuple(r) for r in latest_epoch_losses(spark, scratch).collect()] == [("r", 1, "train", 2.0, 2, 5)]
    assert start_epoch_history


def test_digest_of_a_sparse_3_gb_file(spark, scratch):
    """Larger than a binary cell; read in pieces."""
    os.makedirs(f"{scratch}/sub")
    with open(f"{scratch}/big.bin", "wb") as f:
        f.truncate(3 << 30)
    put(scratch, "sub/a.txt", "abc")
    put(scratch, "_hidden", "x")
    want = hashlib.sha256()
    for _ in range(3 << 10):
        want.update(bytes(1 << 20))
    pins = {"big.bin": want.hexdigest().upper(), "sub/a.txt": "0" * 64, "none.txt": "0" * 64}
    got = {r["name"]: (r["length"], r["status"]) for r in FS.verify_checksum(spark, scratch, pins).collect()}
    assert got == {"big.bin": (3 << 30, "ok"), "sub/a.txt": (3, "mismatch"), "none.txt": (None, "absent")}
    assert {r["name"]: r["status"] for r in FS.verify_checksum(spark, scratch, {}, "*.txt").collect()} == {"sub/a.txt": "unpinned"}
    with pytest.raises(ValueError, match="none.txt"):
        FS.require_checksums(FS.verify_checksum(spark, scratch, pins))
    one = FS.file_digests(spark, f"file:{scratch}/sub/a.txt" if scratch.startswith("/") else f"{scratch}/sub/a.txt").collect()
    assert [(r["name"], r["sha256"]) for r in one] == [("a.txt", hashlib.sha256(b"abc").hexdigest())]


def test_query_of_the_table_files(spark):
    from versio.plans.catalog import registry
    rows = registry()["verify_files"][0](spark, "/root/testdata/sf0.001").collect()
    status = {r["name"]: r["status"] for r in rows}
    assert status.pop("nation.parquet") == "mismatch" and status.pop("region.parquet") == "unpinned" and status.pop("gone.parquet") == "absent"
    assert len(status) >= 10 and set(status.values()) == {"ok"}
    for r in rows:
        if r["status"] != "absent":
            with open(f"/root/testdata/sf0.001/{r['name']}", "rb") as f:
                assert hashlib.sha256(f.read()).hexdigest() == r["sha256"]


def test_query_of_table_files_over_2_gb(spark, scratch):
    """Neither side reads a file as one cell, which ends at 2 GB."""
    from versio.plans.catalog import registry
    put(f"{scratch}/part.parquet", "a b%20c.parquet", "abc")
    put(f"{scratch}/part.parquet", "_hidden.parquet", "x")
    put(scratch, "nation.parquet", "n")
    put(scratch, "region.parquet", "r")
    with open(f"{scratch}/large.parquet", "wb") as f:
        f.truncate((1 << 31) + 7)
    rows = {r["name"]: (r["length"], r["status"]) for r in registry()["verify_files"][0](spark, scratch).collect()}
    assert rows == {"large.parquet": ((1 << 31) + 7, "ok"), "part.parquet/a b%20c.parquet": (3, "ok"), "nation.parquet": (1, "mismatch"),
                    "region.parquet": (1, "unpinned"), "gone.parquet": (None, "absent")}
