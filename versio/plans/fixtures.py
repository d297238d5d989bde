"""Stand-in tables derived from the shared test data, for the parts of an
experiment that come from a model (scores, batch losses).

All are plain projections of the given tables, so their size follows
the data.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Decoding steps per stand-in pair in the score table.
STEPS_PER_PAIR = 16


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch losses from all ``events``: three runs by ``event_id``, day of year
    = epoch, clicks = training batches, views = validation batches, the other
    types = phases of their own (which a history does not use), ``value`` =
    loss, ``k + 1`` = tokens, ``event_id`` = batch order, ``ts`` = when the
    batch ended."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    phase = F.when(F.col("event_type") == "click", F.lit("train")).when(
        F.col("event_type") == "view", F.lit("val")).otherwise(F.col("event_type"))
    return ev.select(
        F.concat(F.lit("run"), F.col("event_id") % 3).alias("run_id"), F.dayofyear("ts").alias("epoch"), phase.alias("phase"),
        F.col("event_id").alias("batch_id"), F.col("value").alias("loss"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("tokens"), "ts")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense positions from ``embeddings``: the vector is the logits row,
    ``label`` the target id."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.col("embedding").alias("logits"), "label")


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, step, token_id, score)``: every embedding row is one
    decoding step, 16 consecutive rows form one pair."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.floor(F.col("vec_id") / STEPS_PER_PAIR).alias("pair_id"),
        (F.col("vec_id") - F.floor(F.col("vec_id") / STEPS_PER_PAIR) * STEPS_PER_PAIR).alias("step"),
        F.posexplode(F.col("embedding")).alias("token_id", "score"))
