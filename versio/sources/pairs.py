"""Sentence-pair sources: the Parquet corpus, language projection and the
adapter that derives pairs from a conversation table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_COLUMNS = {"translation", "id"}


def row_key() -> Column:
    """Position of a row in its source: (hash of the file path, row index in
    the file). Unique and stable across re-reads and lost executors, so it
    breaks ties between byte-identical rows — a hot group of copies then
    still spreads over the range partitions of a sort. Only valid directly
    on a file scan (it reads the hidden ``_metadata`` column)."""
    return F.struct(F.xxhash64(F.col("_metadata.file_path")).alias("file"),
                    F.col("_metadata.row_index").alias("row"))


def read_pairs(spark: SparkSession, path: str, src: str = "en", tgt: str = "it") -> DataFrame:
    """Load a pair corpus (``id``, ``translation`` struct keyed by language,
    plus ``row_key``). The column check reads only the Parquet footer
    schema; no job runs.
    """
    df = spark.read.parquet(path)
    check_pair_columns(df, src, tgt)
    return df.withColumn("row_key", row_key())


def check_pair_columns(df: DataFrame, src: str = "en", tgt: str = "it") -> None:
    """Schema-only check that the pair table has ``id``, ``translation`` and both languages."""
    names = set(df.columns)
    if not REQUIRED_COLUMNS.issubset(names):
        raise ValueError(f"pair table needs columns {sorted(REQUIRED_COLUMNS)}; got {df.columns}")
    fields = set(df.schema["translation"].dataType.fieldNames())
    missing = {src, tgt} - fields
    if missing:
        raise ValueError(f"translation struct lacks languages {sorted(missing)}; has {sorted(fields)}")


def project_lang(df: DataFrame, lang: str, alias: str | None = None) -> Column:
    """The text of one language, ``row["translation"][lang]``."""
    return F.col(f"translation.{lang}").alias(alias or lang)


def pairs_from_conversations(conversations: DataFrame, src: str = "en", tgt: str = "it",
                             first_role: str = "user", second_role: str = "assistant") -> DataFrame:
    """Pairs (user turn, the assistant turn right after it) as a pair corpus.

    ``id = conv_id * 1000000000 + turn``, so turn numbers of a conversation of
    any likely length stay apart; ``row_key`` is the user turn's position
    in its file (``conversations`` must be a plain file scan). Written as an equi-join on
    ``(conv_id, turn + 1)`` rather than ``lead()`` over a conversation, so a
    huge conversation is spread over many tasks instead of one window.
    """
    first = conversations.where(F.col("role") == first_role).select(
        "conv_id", F.col("turn").alias("_t1"), F.col("text").alias("_src"), row_key().alias("row_key"))
    second = conversations.where(F.col("role") == second_role).select(
        "conv_id", (F.col("turn") - 1).alias("_t1"), F.col("text").alias("_tgt"))
    joined = first.join(second, ["conv_id", "_t1"])
    return joined.select(
        (F.col("conv_id") * 1000000000 + F.col("_t1")).alias("id"),
        F.struct(F.col("_src").alias(src), F.col("_tgt").alias(tgt)).alias("translation"),
        "row_key",
    )


def load_fixture_pairs(spark: SparkSession, sf_dir: str, src: str = "en", tgt: str = "it") -> DataFrame:
    """The pair stand-in from the shared ``conversations`` table."""
    return pairs_from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), src, tgt)


# DuckDB text of the same adapter, shared by the oracles.
PAIRS_SQL = """
SELECT u.conv_id * 1000000000 + u.turn AS id, u.text AS en, a.text AS it
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""
