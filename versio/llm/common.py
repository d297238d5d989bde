"""Helpers shared by the training-data operators."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import remove_table
from ..session import ensure_checkpoint_dir

#: A side with at most this many rows and bytes is broadcast; beyond it the
#: same join runs as a shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for
    those it is told to keep: nothing else may be read later."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove_table(spark, path)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the
    lineage is cut, and a lost executor only costs re-reading files. ``keep``
    hands the table over to what is around the innermost ``scratch_tables``."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    level = _scratch[:-1] if keep else _scratch
    if level:
        level[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value).cast("long")
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_value_bytes(value[f.name], f.dataType), F.lit(0)) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + F.coalesce(_value_bytes(x, kind.elementType), F.lit(8)))
    return F.lit(8).cast("long")


def not_broadcast(df: DataFrame) -> DataFrame:
    """``df`` with the hint that its join shuffles. Spark's estimate takes compressed
    files for the size of a written table and does not count the rows that an
    explode adds, so it may broadcast what the driver cannot hold."""
    return df.hint("merge")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most
    ``max_rows`` rows and ``max_bytes`` bytes, else with the one that the join
    shuffles. ``df`` should be a written table: it is read for that."""
    size = sum((F.coalesce(_value_bytes(F.col(f.name), f.dataType), F.lit(8)) for f in df.schema.fields), F.lit(0))
    rows, held = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= max_rows and (held or 0) <= max_bytes else not_broadcast(df)


def with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, row, text``: a row is known by its id and the hash of id and text,
    so rows without an id and repeated ids work; repeated rows are one document."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one column ``id_col``).
    A null id never matches, so such a row stays."""
    return docs.join(checked_broadcast(ids), id_col, "left_anti")


def edge_mark(edges: DataFrame) -> tuple:
    """Number of the edges ``u, v`` and the sum of their hashes, to see a change
    by; a decimal, since a long overflows at some 2^24 edges."""
    h = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)).cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(u long, v long)``.

    Alternating large-star and small-star rounds: each node's smallest
    neighbour is found by an aggregation (combined on the map side) and joined
    back, so a hub is never gathered in one task, and the number of rounds
    grows with the logarithm of the longest chain. Every round is a table in
    the shared folder; Spark may broadcast a side only of a few edges. Returns ``node, root`` for each node with an edge; the
    root is the component's smallest node."""
    def star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        return pairs, pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def both(df: DataFrame) -> DataFrame:
        """Each edge in both directions, as a narrow explode."""
        return df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
                                   ).alias("e")).select("e.u", "e.v")

    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .where("u != v").distinct(), "cc")
    seen = edge_mark(cur)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        side = not_broadcast if 2 * seen[0] > BROADCAST_ROWS else lambda df: df
        sym, low = star(both(cur))
        large = (sym.join(side(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        large = materialize(large, "cc")
        pairs, low = star(large)  # here v < u: every row is a link to a smaller node
        linked = pairs.join(side(low), "u")
        small = (linked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                 F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u != v").distinct())
        cur = materialize(small, "cc")
        now = edge_mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
