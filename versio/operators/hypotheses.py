"""From model scores to hypotheses: greedy choice, truncation, batch
scoring with a user model, and the prediction table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EOS_ID, SOS_ID
from .encoding import decode_texts


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def greedy_pick(scores: DataFrame, group_cols=("pair_id", "step"), token_col: str = "token_id",
                score_col: str = "score", out_col: str = "token_id") -> DataFrame:
    """Top token per decoding step from long scores; ties go to the lowest id."""
    pick = F.max_by(F.col(token_col), F.struct(F.col(score_col), -F.col(token_col)))
    return scores.groupBy(*group_cols).agg(pick.alias(out_col))


def argmax_dense(logits) -> Column:
    """0-based index of the first maximum of a dense score array."""
    z = _c(logits)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def truncate_hypothesis(picks, max_len: int) -> Column:
    """``[SOS]`` followed by the picks, cut right after the first ``[EOS]``
    (kept) and at ``max_len`` ids in total."""
    p = _c(picks)
    seq = F.concat(F.array(F.lit(SOS_ID).cast("int")), p)
    eos = F.array_position(p, F.lit(EOS_ID))
    n = F.when(eos > 0, F.least(eos + 1, F.lit(max_len))).otherwise(
        F.least(F.size(p) + 1, F.lit(max_len)))
    return F.slice(seq, F.lit(1), n.cast("int"))


def assemble_hypotheses(picks: DataFrame, max_len: int, pair_col: str = "pair_id",
                        step_col: str = "step", token_col: str = "token_id") -> DataFrame:
    """``(pair_id, hypothesis)`` from per-step picks. Steps beyond what a
    decode of ``max_len`` can reach are dropped before collecting, so every
    collected list has at most ``max_len - 1`` entries."""
    reachable = picks.where(F.col(step_col) < max_len - 1)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(step_col), F.col(token_col).cast("int").alias(token_col))))
    return reachable.groupBy(pair_col).agg(
        truncate_hypothesis(F.transform(ordered, lambda x: x[token_col]), max_len).alias("hypothesis"))


def score_corpus(df: DataFrame, make_model, input_col: str = "encoder_input",
                 out_col: str = "hypothesis", seq_len: int | None = None,
                 batch_size: int = 64) -> DataFrame:
    """Apply a user model to every row in Arrow batches.

    ``make_model()`` runs once per Python worker and returns a function from
    a NumPy ``(batch, seq_len)`` int array to a ``(batch, out_len)`` int
    array. Uses ``predict_batch_udf``; the model is the only Python code.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    if seq_len is None:
        raise ValueError("seq_len is needed to shape the input tensor")
    udf = predict_batch_udf(make_model, return_type=T.ArrayType(T.IntegerType()),
                            batch_size=batch_size, input_tensor_shapes=[[seq_len]])
    return df.withColumn(out_col, udf(F.col(input_col)))


def prediction_table(pairs: DataFrame, hypotheses: DataFrame, vocab: DataFrame, lang: str,
                     key: str = "id", hyp_col: str = "hypothesis",
                     src_col: str = "src_text", ref_col: str = "tgt_text") -> DataFrame:
    """``(source, reference, prediction)``: hypotheses decoded with the target
    vocabulary and joined to their pairs, by id and, where both sides carry it,
    ``row_key`` (ids may repeat, positions do not)."""
    keys = [key] + [c for c in ("row_key",) if c in pairs.columns and c in hypotheses.columns]
    decoded = decode_texts(hypotheses, keys, hyp_col, vocab, lang, "prediction")
    return pairs.join(decoded, keys).select(
        key, F.col(src_col).alias("source"), F.col(ref_col).alias("reference"), "prediction")
