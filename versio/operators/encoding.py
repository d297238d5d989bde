"""Text → id arrays and back, and the unknown-token rate.

Two equivalent strategies:

* ``lookup`` (default): the JVM regex splits the text, and the token → id
  lookup runs in Arrow batches against the vocabulary shipped to every
  executor as a broadcast variable. The vocabulary is capped (``cap``
  entries per language, checked before it is shipped), so the transform
  is narrow: no shuffle, no join back, whatever the corpus size.
* ``join``: pure JVM — explode tokens with their positions, broadcast-join
  the vocabulary, collect again per row key. It shuffles one row per token,
  which at corpus scale is as large as the text itself.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import encode_tokens
from ..schemas import EOS_ID, VOCAB_CAP
from .partitioning import spread_rows
from .vocab import bounded


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _vocab_tables(vocab: DataFrame, langs, cap: int):
    """``lang -> (tokens, ids)`` of a capped vocabulary: at most ``cap`` rows
    per language, seen before they are collected."""
    rows = vocab.where(F.col("lang").isin(list(langs))).select("lang", "token", "id").limit(cap * len(langs) + 1).collect()
    tables = {lang: ([], []) for lang in langs}
    for r in rows:
        tables[r["lang"]][0].append(r["token"])
        tables[r["lang"]][1].append(r["id"])
    for lang, (tokens, _) in tables.items():
        if len(tokens) > cap:
            raise ValueError(f"vocabulary of {lang} has more entries than the bound {cap}")
    return tables


def _offsets(lists: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _lookup_udf(broadcast_tables, lang: str):
    def token_ids(tokens: pa.Array) -> pa.Array:
        words, ids = broadcast_tables.value[lang]
        at = pc.index_in(tokens.flatten(), value_set=pa.array(words, pa.string()))
        found = pc.fill_null(pc.take(pa.array(ids, pa.int32()), at), 0)
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(_offsets(tokens, sizes), found)

    return F.arrow_udf(token_ids, T.ArrayType(T.IntegerType()))


def encode_columns(df: DataFrame, specs: dict, vocab: DataFrame, cap: int = VOCAB_CAP,
                   partitions: int | None = None) -> DataFrame:
    """``df`` plus an ``array<int>`` column per spec (``out -> (text, lang)``),
    computed row by row with no shuffle; unknown tokens become 0 and a text
    without tokens gives an empty array."""
    langs = sorted({lang for _, lang in specs.values()})
    tables = _vocab_tables(vocab, langs, cap)
    bc = df.sparkSession.sparkContext.broadcast(tables)
    out = spread_rows(df, partitions)
    for name, (text, lang) in specs.items():
        out = out.withColumn(name, _lookup_udf(bc, lang)(encode_tokens(_c(text))))
    return out


def encode_ids(df: DataFrame, key_cols, specs: dict, vocab: DataFrame, method: str = "lookup",
               cap: int = VOCAB_CAP) -> DataFrame:
    """``(key..., out_col...)`` with ``array<int>`` ids for every spec.

    ``specs`` maps an output column to ``(text column, language)``. Unknown
    tokens become 0; a text without tokens gives an empty array (never a
    dropped row). ``key_cols`` must identify a row.
    """
    key_cols = list(key_cols)
    if method == "lookup":
        return encode_columns(df, specs, vocab, cap).select(*key_cols, *specs)
    if method != "join":
        raise ValueError(f"unknown method {method}")
    parts = [F.struct(F.lit(out).alias("out"), F.lit(lang).alias("lang"), _c(text).alias("text"))
             for out, (text, lang) in specs.items()]
    sides = df.select(*key_cols, F.explode(F.array(*parts)).alias("_s"))
    long = sides.select(*key_cols, F.col("_s.out").alias("_out"), F.col("_s.lang").alias("lang"),
                        F.posexplode_outer(encode_tokens("_s.text")).alias("_pos", "token"))
    v = vocab.select("lang", "token", F.col("id").alias("_tok_id"))
    looked_up = long.join(bounded(v, cap * len(specs)), ["lang", "token"], "left")
    entry = F.struct(F.col("_pos"), F.coalesce(F.col("_tok_id"), F.lit(0)).alias("id"))
    aggs = []
    for out in specs:
        picked = F.array_sort(F.collect_list(
            F.when((F.col("_out") == out) & F.col("_pos").isNotNull(), entry)))
        aggs.append(F.transform(picked, lambda x: x["id"]).alias(out))
    return looked_up.groupBy(*key_cols).agg(*aggs)


def encode(df: DataFrame, key_cols, specs: dict, vocab: DataFrame, method: str = "lookup",
           cap: int = VOCAB_CAP) -> DataFrame:
    """``df`` with the id arrays of ``specs`` added."""
    if method == "lookup":
        return encode_columns(df, specs, vocab, cap)
    ids = encode_ids(df, key_cols, specs, vocab, method, cap)
    return df.join(ids, list(key_cols))


def token_count(text) -> F.Column:
    """Number of ids the encoder produces for a text: one token, one id,
    so this needs no vocabulary."""
    return F.size(encode_tokens(_c(text)))


def _decode_udf(broadcast_table):
    def text(ids: pa.Array) -> pa.Array:
        table = pa.array(broadcast_table.value, pa.string())
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        known = np.append(table.is_valid().to_numpy(zero_copy_only=False), False)
        keep = (flat > EOS_ID) & (flat < len(table))
        keep &= known[np.where(keep, flat, len(table))]
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(sizes)
        kept = before[ends] - before[ends - sizes]
        tokens = table.take(pa.array(flat[keep]))
        return pc.binary_join(pa.ListArray.from_arrays(_offsets(ids, kept), tokens), " ")

    return F.arrow_udf(text, T.StringType())


def decode_column(df: DataFrame, ids_col: str, vocab: DataFrame, lang: str, out_col: str = "text",
                  cap: int = VOCAB_CAP) -> DataFrame:
    """``df`` plus the decoded text of ``ids_col`` (narrow, no shuffle)."""
    tokens, ids = _vocab_tables(vocab, [lang], cap)[lang]
    by_id = [None] * (max(ids, default=-1) + 1)
    for tok, i in zip(tokens, ids, strict=True):
        by_id[i] = tok
    bc = df.sparkSession.sparkContext.broadcast(by_id)
    return df.withColumn(out_col, _decode_udf(bc)(F.col(ids_col)))


def decode_texts(df: DataFrame, key_cols, ids_col: str, vocab: DataFrame, lang: str,
                 out_col: str = "text", method: str = "lookup", cap: int = VOCAB_CAP) -> DataFrame:
    """``(key..., out_col)``: ids → tokens joined by one space; the four
    specials (``[UNK]`` included) and ids outside the vocabulary are dropped."""
    key_cols = list(key_cols)
    if method == "lookup":
        return decode_column(df, ids_col, vocab, lang, out_col, cap).select(*key_cols, out_col)
    long = df.select(*key_cols, F.posexplode_outer(F.col(ids_col)).alias("_pos", "_tok_id"))
    v = vocab.where(F.col("lang") == lang).select(F.col("id").alias("_tok_id"), F.col("token").alias("_tok"))
    looked_up = long.join(bounded(v, cap), "_tok_id", "left")
    keep = F.col("_pos").isNotNull() & (F.col("_tok_id") > EOS_ID) & F.col("_tok").isNotNull()
    picked = F.array_sort(F.collect_list(F.when(keep, F.struct("_pos", "_tok"))))
    return looked_up.groupBy(*key_cols).agg(
        F.array_join(F.transform(picked, lambda x: x["_tok"]), " ").alias(out_col))


def decode(df: DataFrame, key_cols, ids_col: str, vocab: DataFrame, lang: str,
           out_col: str = "text", method: str = "lookup", cap: int = VOCAB_CAP) -> DataFrame:
    """``df`` plus the decoded text of ``ids_col`` (lookup: narrow; join: joined back on the key)."""
    if method == "lookup":
        return decode_column(df, ids_col, vocab, lang, out_col, cap)
    return df.join(decode_texts(df, key_cols, ids_col, vocab, lang, out_col, method, cap), list(key_cols))


def oov_rate(df: DataFrame, group_cols, ids_cols) -> DataFrame:
    """Share of ``[UNK]`` ids per group, per id column (no explode needed)."""
    aggs = []
    for c in ids_cols:
        unk = F.sum(F.size(F.filter(F.col(c), lambda x: x == 0)))
        total = F.sum(F.size(F.col(c)))
        aggs += [unk.cast("bigint").alias(f"{c}_unk"), total.cast("bigint").alias(f"{c}_tokens"),
                 (unk / total).alias(f"{c}_oov_rate")]
    return df.groupBy(*group_cols).agg(*aggs)
