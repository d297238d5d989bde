"""Epoch losses while training runs: batch-loss files arrive in a folder,
a Structured Streaming query keeps the token-weighted loss of every
(run, epoch, phase) current and appends each micro-batch's updates to a
history table. Restarts resume from the checkpoint location; a micro-batch that
is replayed is appended once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import BATCH_LOSS
from ..sources.appends import append_rows, read_rows

KEY = ("run_id", "epoch", "phase")


def batch_loss_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Batch-loss Parquet files arriving in ``folder``, with the fixed schema."""
    reader = spark.readStream.schema(BATCH_LOSS).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(folder)


def epoch_loss_updates(batches: DataFrame) -> DataFrame:
    """Running per-epoch sums; the state holds one row per (run, epoch, phase)."""
    return batches.groupBy("run_id", "epoch", "phase").agg(
        F.sum(F.col("loss") * F.col("tokens")).alias("loss_tokens"),
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.count(F.lit(1)).alias("batches"))


def start_epoch_history(spark: SparkSession, folder: str, out_path: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """Start the stream; every micro-batch is one append to ``out_path``, known
    by the stream's checkpoint and the micro-batch id."""
    updates = epoch_loss_updates(batch_loss_stream(spark, folder))

    def write(batch: DataFrame, batch_id: int) -> None:
        append_rows(batch, out_path, key=f"{checkpoint} {batch_id}")

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_epoch_losses(spark: SparkSession, out_path: str) -> DataFrame:
    """The current epoch losses: newest update per (run, epoch, phase)."""
    rows = read_rows(spark, out_path, KEY)
    if rows is None:
        raise ValueError(f"no epoch losses at {out_path} yet")
    return rows.select(*KEY, (F.col("loss_tokens") / F.col("tokens")).alias("epoch_loss"), "batches", "tokens")


__all__ = ["batch_loss_stream", "epoch_loss_updates", "start_epoch_history", "latest_epoch_losses"]
