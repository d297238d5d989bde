"""Exact global rank and running sums without a one-partition window.

``exact_rank`` is the DataFrame form of an indexed sort. The rows are
range-partitioned on the order key (boundaries sampled, so a heavy range of
the leading column is split across tasks as long as the whole key is
unique), sorted inside each partition and written once as Parquet to the
session's shared checkpoint folder: one file per partition, rows in key
order. From then on the partitions are fixed files, so counts and positions
come from the same data (two independent evaluations of a range exchange
may sample different boundaries). Row counts per file come from Parquet
metadata (no data column is read), a row's position is its
``_metadata.row_index`` in its file, and rank = rows in earlier files +
position. The count table has one row per file and is broadcast; later
reads of the table prune columns like any Parquet scan.

The order key must be a total order (end it with a unique column); ties
would make the rank depend on layout.
"""

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _partitions(df: DataFrame, num_partitions):
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# The part-file naming of Spark's file writers
# (part-<partition>-<job>-c<file>), which orders the files of one write.
PART_FILE_RE = r"^part-(\d+)-.*-c(\d+)"


def exact_rank(df: DataFrame, order_cols, rank_col: str = "rank",
               total_col: str | None = None, num_partitions: int | None = None,
               drop_after_sort=(), with_path: bool = False):
    """Add a 1-based ``rank_col`` (bigint) in the total order of ``order_cols``.

    Runs one job when called (the sort and its write); the result is a plan
    over the written table. With ``total_col`` the row count of ``df`` is
    added as well, from the per-file counts (no driver round trip).
    ``drop_after_sort`` names sort-only helper columns that are not written.
    ``with_path`` also returns the table's folder, for ``remove_table``.
    """
    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    n = _partitions(df, num_partitions)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rank-{uuid.uuid4().hex}"
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*drop_after_sort)
    ordered.write.mode("errorifexists").parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path)  # known schema: no footer scan
    file_name = F.col("_metadata.file_name")
    counts = stored.select(file_name.alias("_rk_file")).groupBy("_rk_file").agg(
        F.count(F.lit(1)).alias("_rk_cnt"))
    # one row per written file (≤ partitions × files per partition): the
    # unpartitioned windows and the broadcast are bounded by that, not by data
    file_order = [F.regexp_extract("_rk_file", PART_FILE_RE, 1).cast("int"),
                  F.regexp_extract("_rk_file", PART_FILE_RE, 2).cast("int"), F.col("_rk_file")]
    before = Window.orderBy(*file_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_rk_file",
        F.coalesce(F.sum("_rk_cnt").over(before), F.lit(0)).alias("_rk_off"),
        F.sum("_rk_cnt").over(Window.partitionBy()).alias("_rk_total"),
    )
    positioned = stored.select("*", file_name.alias("_rk_file"), F.col("_metadata.row_index").alias("_rk_pos"))
    out = positioned.join(F.broadcast(offsets), "_rk_file").withColumn(
        rank_col, F.col("_rk_off") + F.col("_rk_pos") + 1)
    if total_col:
        out = out.withColumn(total_col, F.col("_rk_total"))
    out = out.drop("_rk_file", "_rk_pos", "_rk_off", "_rk_total")
    return (out, path) if with_path else out


def remove_table(spark, path: str) -> None:
    """Delete a table that ``exact_rank`` wrote, once its rows are no longer needed."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def running_sums(df: DataFrame, partition_cols, order_col: str, value_cols,
                 prefix: str = "cum_", block_size: int = 4096) -> DataFrame:
    """Cumulative sums of ``value_cols`` per partition key in ``order_col`` order
    (rows from the first up to the current one).

    Two levels, so no window ever holds a whole partition key: block sums over
    ``floor(order / block_size)``, a running total over the (much smaller)
    block table, then a running sum inside each block. ``order_col`` must be
    numeric and unique within a partition key.
    """
    parts = list(partition_cols)
    blk = F.floor(F.col(order_col) / F.lit(block_size)).alias("_rs_block")
    with_block = df.withColumn("_rs_block", blk)
    sums = with_block.groupBy(*parts, "_rs_block").agg(
        *[F.sum(v).alias(f"_rs_b_{v}") for v in value_cols])
    prev_blocks = Window.partitionBy(*parts).orderBy("_rs_block").rowsBetween(
        Window.unboundedPreceding, -1)
    block_offsets = sums.select(
        *parts, "_rs_block",
        *[F.coalesce(F.sum(f"_rs_b_{v}").over(prev_blocks), F.lit(0)).alias(f"_rs_o_{v}")
          for v in value_cols])
    inside = Window.partitionBy(*parts, "_rs_block").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, 0)
    joined = with_block.join(block_offsets, [*parts, "_rs_block"])
    for v in value_cols:
        joined = joined.withColumn(prefix + v, F.col(f"_rs_o_{v}") + F.sum(v).over(inside))
    return joined.drop("_rs_block", *[f"_rs_o_{v}" for v in value_cols])
