"""Spreading an input over more tasks before heavy per-row work."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one task takes apart into n-grams: some hundred times as
#: many bytes of groups, each with its key.
PIECE_BYTES = 2 << 20


def spread_rows(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt round-robin to ``partitions``, or as it is by default. For a
    caller who knows that the input comes in too few pieces (one small file)
    for work that costs far more than moving its rows; Spark sorts rows locally
    before a round-robin repartition, so retries give the same result."""
    return df if partitions is None else df.repartition(int(partitions))


def pieces(table: DataFrame, text_col: str, piece_bytes: int = PIECE_BYTES) -> int:
    """Pieces of about ``piece_bytes`` of the texts of ``table``, at least one a
    core: with so many partitions a task's share stays the same however much the
    table grows. (The files may hold the same texts in far fewer bytes.)"""
    held = table.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-held // piece_bytes))
