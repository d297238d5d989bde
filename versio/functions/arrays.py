"""Array expressions for fixed-length model inputs and their masks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EOS_ID, PAD_ID, SOS_ID


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _ints(*values) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def _pad(count: Column) -> Column:
    return F.array_repeat(F.lit(PAD_ID).cast("int"), F.greatest(count, F.lit(0)).cast("int"))


def encoder_input(ids, seq_len: int) -> Column:
    """``[SOS] + ids + [EOS] + [PAD] * (S - n - 2)``."""
    ids = _c(ids)
    return F.concat(_ints(SOS_ID), ids, _ints(EOS_ID), _pad(F.lit(seq_len) - F.size(ids) - 2))


def decoder_input(ids, seq_len: int) -> Column:
    """``[SOS] + ids + [PAD] * (S - n - 1)``."""
    ids = _c(ids)
    return F.concat(_ints(SOS_ID), ids, _pad(F.lit(seq_len) - F.size(ids) - 1))


def label(ids, seq_len: int) -> Column:
    """``ids + [EOS] + [PAD] * (S - n - 1)`` (decoder input shifted by one)."""
    ids = _c(ids)
    return F.concat(ids, _ints(EOS_ID), _pad(F.lit(seq_len) - F.size(ids) - 1))


def encoder_mask(encoder_ids) -> Column:
    """1 where the id is not ``[PAD]`` (by value)."""
    return F.transform(_c(encoder_ids), lambda x: (x != PAD_ID).cast("int"))


def decoder_mask(decoder_ids, seq_len: int) -> Column:
    """S×S: padding mask AND causal mask ``m[i][j] = j <= i``. S² ints per
    row, so derive it where it is consumed; never store it. The decoder ids
    are zipped to every row index (evaluated once per row, not per cell)."""
    d = _c(decoder_ids)
    rows = F.arrays_zip(F.sequence(F.lit(0), F.lit(seq_len - 1)).alias("i"),
                        F.array_repeat(d, seq_len).alias("d"))
    return F.transform(rows, lambda r: F.transform(
        r["d"], lambda x, j: ((x != PAD_ID) & (j <= r["i"])).cast("int")))


def non_pad_count(ids) -> Column:
    """Number of non-``[PAD]`` ids (the label's token count includes EOS)."""
    return F.size(F.filter(_c(ids), lambda x: x != PAD_ID))
