"""Training-history analytics over a table of many runs.

Every window and group is keyed by ``run_id``; a history has one row per
epoch, so each window holds one run's epochs.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _run_window(run_col: str = "run_id"):
    return Window.partitionBy(run_col).orderBy("epoch")


def _by_val_loss():
    """Order of epochs by loss; null, which ``min_by`` skips, without one."""
    return F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))


def epoch_summary(batches: DataFrame, run_col: str = "run_id") -> DataFrame:
    """History rows from batch losses: 1-based epoch, token-weighted train
    and validation loss, seconds (batch time span, 2 decimals, half-even),
    cumulative training steps."""
    is_train = F.col("phase") == "train"
    is_val = F.col("phase") == "val"
    lt = F.col("loss") * F.col("tokens")
    aggs = [
        (F.sum(F.when(is_train, lt)) / F.sum(F.when(is_train, F.col("tokens")))).alias("train_loss"),
        (F.sum(F.when(is_val, lt)) / F.sum(F.when(is_val, F.col("tokens")))).alias("val_loss"),
        F.count_if(is_train).alias("train_batches"),
    ]
    if "ts" in batches.columns:
        span_us = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts"))
        aggs.append(F.bround(span_us.cast("decimal(20,0)") / F.lit(1000000), 2)
                    .cast("double").alias("seconds"))
    per_epoch = batches.groupBy(run_col, "epoch").agg(*aggs)
    steps = F.sum("train_batches").over(
        _run_window(run_col).rowsBetween(Window.unboundedPreceding, 0))
    return per_epoch.withColumn("global_step", steps.cast("int")).drop("train_batches")


def with_progress(history: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Adds ``best_so_far`` (running minimum of ``val_loss``) and
    ``improved`` (strictly below every earlier epoch; the first always is, and
    an epoch without a validation loss never)."""
    upto = _run_window(run_col).rowsBetween(Window.unboundedPreceding, 0)
    before = _run_window(run_col).rowsBetween(Window.unboundedPreceding, -1)
    prev_best = F.coalesce(F.min("val_loss").over(before), F.lit(float("inf")))
    return (history.withColumn("best_so_far", F.min("val_loss").over(upto))
            .withColumn("improved", F.coalesce(F.col("val_loss") < prev_best, F.lit(False))))


def global_step(history: DataFrame, batches_col: str = "train_batches",
                run_col: str = "run_id") -> DataFrame:
    """Cumulative training batches over the epochs of each run."""
    upto = _run_window(run_col).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("global_step", F.sum(batches_col).over(upto).cast("int"))


def best_epoch(history: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Epoch of the lowest validation loss per run; the first on ties. Epochs
    without a validation loss do not count."""
    return history.groupBy(run_col).agg(
        F.min_by("epoch", _by_val_loss()).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"))


def learning_curve(history: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Long form ``(run, epoch, series, loss, is_best)`` for any chart;
    ``is_best`` marks the validation point of the best epoch."""
    best = F.min_by("epoch", _by_val_loss()).over(Window.partitionBy(run_col))
    long = history.select(run_col, "epoch", "train_loss", "val_loss", best.alias("best_epoch")).unpivot(
        [run_col, "epoch", "best_epoch"], ["train_loss", "val_loss"], "series", "loss")
    return long.withColumn("series", F.regexp_replace("series", "_loss$", "")).select(
        run_col, "epoch", "series", "loss",
        F.coalesce((F.col("series") == "val") & (F.col("epoch") == F.col("best_epoch")), F.lit(False)).alias("is_best"))


def resume_point(history: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Where a run continues: next epoch, step so far and best value."""
    last = F.max_by(F.struct("epoch", "global_step"), "epoch")
    return history.groupBy(run_col).agg(last.alias("_last"), F.min("val_loss").alias("best_val_loss")) \
        .select(run_col, (F.col("_last.epoch") + 1).alias("next_epoch"),
                F.col("_last.global_step").alias("global_step"), "best_val_loss")
