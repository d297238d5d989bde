"""Length filtering and the fixed-length model inputs of a pair table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..schemas import VOCAB_CAP
from .encoding import encode, token_count


def fits(src_tokens: Column, tgt_tokens: Column, seq_len: int) -> Column:
    """Encoder needs SOS+EOS around the source, decoder one marker."""
    return (src_tokens + 2 <= seq_len) & (tgt_tokens + 1 <= seq_len)


def pair_fits(src_text, tgt_text, seq_len: int) -> Column:
    """``fits`` of two texts; false, not null, if one of them is null."""
    return F.coalesce(fits(token_count(src_text), token_count(tgt_text), seq_len), F.lit(False))


def with_token_counts(df: DataFrame, src_text, tgt_text) -> DataFrame:
    """Adds ``src_tokens`` and ``tgt_tokens`` (ids the encoder will produce)."""
    return df.withColumn("src_tokens", token_count(src_text)).withColumn(
        "tgt_tokens", token_count(tgt_text))


def length_filter(df: DataFrame, seq_len: int, src_text="src_text", tgt_text="tgt_text") -> DataFrame:
    """Keep pairs whose inputs fit ``seq_len``. Counting needs no vocabulary,
    so the filter runs before any lookup and Catalyst keeps it below the
    array projection. A pair with a null text does not fit."""
    return df.where(pair_fits(src_text, tgt_text, seq_len))


def length_filter_report(df: DataFrame, seq_len: int, src_text="src_text", tgt_text="tgt_text",
                         group_col: str = "split") -> DataFrame:
    """Rows per split before and after the length filter, in one aggregation."""
    keep = pair_fits(src_text, tgt_text, seq_len)
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(keep).alias("rows_after"))


def require_nonempty_splits(report: DataFrame, splits=("train", "val", "test")) -> dict:
    """Driver check on the (≤3-row) report: every split keeps a row."""
    got = {r["split"]: r["rows_after"] for r in report.collect()}
    empty = [s for s in splits if not got.get(s)]
    if empty:
        raise ValueError(f"splits empty after the length filter: {empty}; raise seq_len")
    return got


def overlong_quarantine(df: DataFrame, seq_len: int, src_text="src_text", tgt_text="tgt_text") -> DataFrame:
    """Rows that would not fit (the complement of ``length_filter``), with the
    ``reason``: ``null_text`` or ``overlong``."""
    null = F.col(src_text).isNull() | F.col(tgt_text).isNull()
    return df.where(~pair_fits(src_text, tgt_text, seq_len)).withColumn(
        "reason", F.when(null, "null_text").otherwise("overlong"))


def reject_overlong(ids_len: Column, limit: int, value: Column) -> Column:
    """``value``, or a job failure if ``ids_len`` exceeds ``limit``."""
    return F.when(ids_len > limit, F.raise_error(F.lit("text has more tokens than the sequence length allows"))).otherwise(value)


def model_input_columns(seq_len: int, src_ids="src_ids", tgt_ids="tgt_ids",
                        with_decoder_mask: bool = True) -> list:
    """The model-input columns of an encoded pair table; overlong rows fail the job."""
    s, t = F.col(src_ids), F.col(tgt_ids)
    enc = reject_overlong(F.size(s), seq_len - 2, A.encoder_input(s, seq_len))
    dec = reject_overlong(F.size(t), seq_len - 1, A.decoder_input(t, seq_len))
    cols = [
        enc.alias("encoder_input"),
        dec.alias("decoder_input"),
        A.label(t, seq_len).alias("label"),
        A.encoder_mask(A.encoder_input(s, seq_len)).alias("encoder_mask"),
    ]
    if with_decoder_mask:
        cols.append(A.decoder_mask(A.decoder_input(t, seq_len), seq_len).alias("decoder_mask"))
    return cols


def model_inputs(df: DataFrame, seq_len: int, key_cols=("id", "row_key"), with_decoder_mask: bool = True,
                 extra_cols=("split",)) -> DataFrame:
    """Arrays of an encoded pair table (``src_ids``, ``tgt_ids``,
    ``src_text``, ``tgt_text``); overlong rows fail the job, as building
    inputs for them is an error, not a silent drop."""
    keep = [c for c in (*key_cols, *extra_cols) if c in df.columns]
    return df.select(*keep, *model_input_columns(seq_len, with_decoder_mask=with_decoder_mask),
                     "src_text", "tgt_text")


def assert_lengths(inputs: DataFrame, seq_len: int) -> DataFrame:
    """One row: number of rows whose arrays are not ``seq_len`` long (0 expected)."""
    bad = F.count_if((F.size("encoder_input") != seq_len) | (F.size("decoder_input") != seq_len)
                     | (F.size("label") != seq_len))
    return inputs.agg(bad.alias("bad_rows"), F.count(F.lit(1)).alias("rows"))


def prompt_input(texts: DataFrame, key_cols, text_col: str, vocab: DataFrame, lang: str,
                 seq_len: int, on_long: str = "fail", cap: int = VOCAB_CAP) -> DataFrame:
    """One-sided inference input: encoded source, padded, with its mask. A
    text longer than ``seq_len - 2`` tokens fails the job, or with
    ``on_long="report"`` has null inputs and the ``status`` ``too_long``
    (``null_text`` for a null one, else ``ok``)."""
    if on_long not in ("fail", "report"):
        raise ValueError(f"unknown on_long {on_long}")
    enc = encode(texts, key_cols, {"src_ids": (text_col, lang)}, vocab, cap=cap)
    s = F.col("src_ids")
    ok = (F.size(s) <= seq_len - 2) & F.col(text_col).isNotNull()
    inp, mask = A.encoder_input(s, seq_len), A.encoder_mask(A.encoder_input(s, seq_len))
    if on_long == "fail":
        return enc.select(*key_cols, text_col, reject_overlong(F.size(s), seq_len - 2, inp).alias("encoder_input"),
                          mask.alias("encoder_mask"))
    status = F.when(ok, "ok").when(F.col(text_col).isNull(), "null_text").otherwise("too_long")
    return enc.select(*key_cols, text_col, status.alias("status"), F.when(ok, inp).alias("encoder_input"),
                      F.when(ok, mask).alias("encoder_mask"))
