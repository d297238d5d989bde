"""Token losses over tables of model outputs and their aggregation.

Cross entropy is computed from dense logits with built-in higher-order
array functions (log-sum-exp with the maximum subtracted), so it stays in
the JVM.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import non_pad_count
from ..schemas import LABEL_SMOOTHING, PAD_ID
from .rank import running_sums


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def log_sum_exp(values) -> Column:
    """Stable ``log Σ exp(x)`` in one pass: the accumulator carries the
    running maximum and the sum rescaled to it, so no lambda refers to an
    outer array (which Catalyst could re-evaluate per element)."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        x = x.cast("double")
        # equal values add 1 (also two infinities, whose difference is no number);
        # minus infinity, a masked entry, adds nothing
        return (F.when(x == float("-inf"), acc)
                .when(x > acc["m"], F.struct(x.alias("m"), (acc["s"] * F.exp(acc["m"] - x) + 1).alias("s")))
                .otherwise(F.struct(acc["m"].alias("m"), (acc["s"] + F.when(x == acc["m"], 1.0).otherwise(
                    F.exp(x - acc["m"]))).alias("s"))))

    return F.aggregate(_c(values), init, step, lambda acc: F.when(acc["s"] == 0, acc["m"]).otherwise(acc["m"] + F.log(acc["s"])))


def token_loss(logits, label, smoothing: float = LABEL_SMOOTHING) -> Column:
    """Per-position loss ``(1-ε)(lse - z_y) + ε(lse - mean z)``; ε = 0 is the
    plain cross entropy. Logits are read as double."""
    z = _c(logits)
    lse = log_sum_exp(z)
    z_y = F.element_at(z, _c(label) + 1).cast("double")
    if smoothing == 0:
        return lse - z_y  # a masked entry has no part in the mean either
    mean_z = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(z)
    return (1.0 - smoothing) * (lse - z_y) + smoothing * (lse - mean_z)


def cross_entropy(df: DataFrame, logits: str, label: str, smoothing: float = LABEL_SMOOTHING,
                  ignore_index: int = PAD_ID, group_cols=()) -> DataFrame:
    """Mean loss over positions whose label is not ``ignore_index``
    (``[PAD]``), with the number of positions counted."""
    keep = F.col(label) != ignore_index
    loss = F.when(keep, token_loss(logits, label, smoothing))
    return df.groupBy(*group_cols).agg(
        F.avg(loss).alias("loss"), F.count_if(keep).alias("tokens"))


#: Scores of a position are summed in bins of this width, so that no exponential
#: in a bin overflows or vanishes.
SCORE_BIN = 512


def position_losses(scores: DataFrame, labels: DataFrame, key_cols=("pair_id", "step"), token_col: str = "token_id",
                    score_col: str = "score", label_col: str = "label", smoothing: float = LABEL_SMOOTHING,
                    ignore_index: int = PAD_ID) -> DataFrame:
    """``(key..., loss)`` of every position from long scores, one row per token.

    The log-sum-exp is a two-phase aggregation of parts that can be merged: per
    position and bin of scores the sum of the exponentials scaled by the bin's
    upper end, then the two highest bins (what lies lower is below rounding). A
    position's scores may lie in any number of rows and tasks. Joined and
    aggregated by the position's key, the scores are shuffled once. Positions
    with an ignored or null label, or without scores, do not come back; one
    whose label has no score is an error. Minus infinity is a masked token."""
    wanted = labels.where(F.col(label_col) != ignore_index).select(*key_cols, F.col(label_col).alias("_label"))
    x = F.col(score_col).cast("double")
    odd = F.isnan(x) | (x == float("inf"))
    rows = scores.join(wanted, list(key_cols)).select(
        *key_cols, x.alias("_x"), F.when(F.col(token_col) == F.col("_label"), x).alias("_own"),
        F.when(~odd & (x != float("-inf")), F.rint(x / SCORE_BIN - 0.5)).alias("_bin"), F.when(odd, x).alias("_odd"))
    parts = rows.groupBy(*key_cols, "_bin").agg(
        F.sum(F.exp(F.col("_x") - (F.col("_bin") + 1) * float(SCORE_BIN))).alias("_s"), F.sum("_x").alias("_sum"),
        F.count(F.lit(1)).alias("_n"), F.max("_own").alias("_own"), F.max("_odd").alias("_odd"))
    bins = F.sort_array(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_s"))), asc=False)
    whole = parts.groupBy(*key_cols).agg(bins.alias("_bins"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"),
                                         F.max("_own").alias("_own"), F.max("_odd").alias("_odd"))
    top, next_ = F.get("_bins", F.lit(0)), F.get("_bins", F.lit(1))
    below = F.coalesce(next_["_s"] * F.exp((next_["_bin"] - top["_bin"]) * F.lit(float(SCORE_BIN))), F.lit(0.0))
    lse = (F.when(F.col("_odd").isNotNull(), F.col("_odd")).when(top.isNull(), F.lit(float("-inf")))
           .otherwise((top["_bin"] + 1) * F.lit(float(SCORE_BIN)) + F.log(top["_s"] + below)))
    own = F.coalesce("_own", F.raise_error("no score for the label of a position").cast("double"))
    loss = lse - own
    if smoothing:
        loss = (1.0 - smoothing) * loss + smoothing * (lse - F.col("_sum") / F.col("_n"))
    return whole.select(*key_cols, loss.alias("loss"))


def cross_entropy_of_scores(scores: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row ``loss, tokens`` like ``cross_entropy``, from long scores."""
    return position_losses(scores, labels, **settings).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("tokens"))


def label_tokens(label_ids) -> Column:
    """Non-``[PAD]`` label positions of a row (``[EOS]`` included)."""
    return non_pad_count(label_ids)


def batch_loss(df: DataFrame, logits: str, label: str, batch_cols=("batch_id",), smoothing: float = LABEL_SMOOTHING,
               ignore_index: int = PAD_ID) -> DataFrame:
    """``(batch..., loss, tokens)``: mean loss and number of the positions that
    count, per batch, as ``epoch_loss`` takes them."""
    return cross_entropy(df, logits, label, smoothing, ignore_index, batch_cols)


def epoch_loss(batches: DataFrame, group_cols=("run_id", "epoch", "phase")) -> DataFrame:
    """Token-weighted mean ``Σ(loss·tokens)/Σtokens`` and the number of batches."""
    g = [c for c in group_cols if c in batches.columns]
    return batches.groupBy(*g).agg(
        (F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("epoch_loss"),
        F.count(F.lit(1)).alias("batches"),
        F.sum("tokens").cast("bigint").alias("tokens"))


def running_loss(batches: DataFrame, group_cols=("run_id", "epoch", "phase"),
                 order_col: str = "batch_id") -> DataFrame:
    """The same ratio after every batch (the progress value), computed with
    two-level running sums so a long epoch never sits in one window task."""
    g = [c for c in group_cols if c in batches.columns]
    weighted = batches.withColumn("_lt", F.col("loss") * F.col("tokens"))
    sums = running_sums(weighted, g, order_col, ["_lt", "tokens"])
    return sums.withColumn("running_loss", F.col("cum__lt") / F.col("cum_tokens")).drop(
        "_lt", "cum__lt")
