"""Per-epoch decisions while training runs: as history rows arrive, keep the
best validation loss of every run and flag each epoch that improved on it
(the decision that keeps a "best" checkpoint).

The state per run is the best loss and the epochs seen, kept by
``applyInPandasWithState``; each group holds one run's newly arrived epochs.
An epoch that was seen before is a replay and is skipped, so re-delivered files
do not change the output. One that arrives after a newer epoch is judged against
what has arrived so far and has the status ``late``; nothing is dropped.
"""

from math import inf, isnan, nan

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schemas import HISTORY

HISTORY_ROWS = T.StructType([T.StructField("run_id", T.StringType())] + HISTORY.fields)

PROGRESS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("best_so_far", T.DoubleType()),
    T.StructField("improved", T.BooleanType()),
    T.StructField("status", T.StringType()),
])
STATE = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("seen", T.ArrayType(T.IntegerType()))])


def _advance(key, batches, state):
    best, seen = (state.get if state.exists else (inf, []))
    seen = set(seen)
    last = max(seen, default=0)
    arrived = sorted((int(e), float(v) if v is not None else nan) for pdf in batches for e, v in zip(pdf["epoch"], pdf["val_loss"]))
    rows = []
    for epoch, val in arrived:  # all chunks of the group, in epoch order
        if epoch in seen:
            continue
        val = None if isnan(val) else val  # an epoch without validation decides nothing
        improved = val is not None and val < best
        best = best if val is None else min(best, val)
        rows.append((key[0], epoch, val, None if best == inf else best, improved, "late" if epoch < last else "in_order"))
        seen.add(epoch)
        last = max(last, epoch)
    state.update((best, sorted(seen)))
    if rows:
        yield pd.DataFrame(rows, columns=[f.name for f in PROGRESS.fields])


def progress_updates(history: DataFrame) -> DataFrame:
    """Streaming ``(run_id, epoch, val_loss, best_so_far, improved, status)``."""
    return history.groupBy("run_id").applyInPandasWithState(
        _advance, PROGRESS, STATE, "append", GroupStateTimeout.NoTimeout)


def start_progress(spark: SparkSession, folder: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Read history files as they land in ``folder`` and append the
    decisions to a Parquet table (exactly once through the checkpoint)."""
    history = spark.readStream.schema(HISTORY_ROWS).parquet(folder)
    return (progress_updates(history).writeStream.outputMode("append").format("parquet")
            .option("path", out_path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
