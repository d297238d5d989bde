"""Corpus translation metrics: n-gram counts, BLEU-4, CER, WER.

BLEU follows Papineni et al. (2002): one reference, no smoothing, clipped
n-gram precisions for n = 1..4 with equal weights, brevity penalty
``exp(1 - r/c)`` when the hypotheses are not longer than the references,
and 0 as soon as any clipped sum is 0. CER and WER are ratios of sums
(edit operations over reference characters / words), not means of ratios.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit import char_distance, text_errors, word_distance
from ..functions.text import ngrams, whitespace_words
from .partitioning import spread_rows

MAX_N = 4


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _text(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def _tagged(words: Column, n: int) -> Column:
    return F.transform(ngrams(words, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


def _all_ngrams(words: Column, max_n: int) -> Column:
    return F.flatten(F.array(*[_tagged(words, n) for n in range(1, max_n + 1)]))


def ngram_counts(df: DataFrame, key_cols, text_col, max_n: int = MAX_N, partitions: int | None = None) -> DataFrame:
    """``(key..., n, gram, count)`` of word n-grams of whitespace-split text.
    With ``partitions`` both the rows and their n-grams are dealt to so many
    tasks, whose groups then take the memory of that share."""
    # the words are a column of their own before the generator, so the
    # regex runs once per row, not once per reference inside the n-gram lists
    w = spread_rows(df, partitions).select(*key_cols, whitespace_words(_text(text_col)).alias("_w"))
    g = w.select(*key_cols, F.explode(_all_ngrams(F.col("_w"), max_n)).alias("_g")).select(*key_cols, "_g.n", "_g.gram")
    if partitions is not None:
        g = g.repartition(int(partitions), *key_cols, "n", "gram")
    return g.groupBy(*key_cols, "n", "gram").agg(F.count(F.lit(1)).alias("count"))


def bleu_stats(df: DataFrame, key_cols, hyp_col, ref_col, max_n: int = MAX_N, partitions: int | None = None) -> DataFrame:
    """One row: clipped and total n-gram counts per n, hypothesis and
    reference lengths in words.

    Both sides' n-grams go through one aggregation keyed by (row, n, gram)
    — no join — and frequent n-grams cannot skew it because the key holds
    the row. Rows are told apart by a number of their own, so repeated ids in
    ``key_cols`` stay separate pairs. With ``partitions`` the rows are dealt to
    so many tasks by that number and their n-grams are counted where they are.
    """
    key_cols = ["_row"]
    side = F.array(
        F.struct(F.lit(0).alias("side"), whitespace_words(_text(hyp_col)).alias("w")),
        F.struct(F.lit(1).alias("side"), whitespace_words(_text(ref_col)).alias("w")))
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    if partitions is not None:
        rows = rows.repartition(int(partitions), "_row")
    s = rows.select(*key_cols, F.explode(side).alias("_s"))
    g = s.select(*key_cols, F.col("_s.side").alias("side"),
                 F.explode(_all_ngrams(F.col("_s.w"), max_n)).alias("_g"))
    counts = g.groupBy(*key_cols, F.col("_g.n").alias("n"), F.col("_g.gram").alias("gram")).agg(
        F.count_if(F.col("side") == 0).alias("h"), F.count_if(F.col("side") == 1).alias("r"))
    aggs = []
    for n in range(1, max_n + 1):
        at_n = F.col("n") == n
        aggs.append(F.coalesce(F.sum(F.when(at_n, F.least("h", "r"))), F.lit(0)).cast("bigint").alias(f"clipped_{n}"))
        aggs.append(F.coalesce(F.sum(F.when(at_n, F.col("h"))), F.lit(0)).cast("bigint").alias(f"total_{n}"))
    aggs.append(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("h"))), F.lit(0)).cast("bigint").alias("hyp_len"))
    aggs.append(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("r"))), F.lit(0)).cast("bigint").alias("ref_len"))
    return counts.agg(*aggs)


def bleu_from_stats(stats: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """Corpus BLEU and the n-gram precisions from the one-row statistics."""
    clipped = [F.col(f"clipped_{n}") for n in range(1, max_n + 1)]
    totals = [F.col(f"total_{n}") for n in range(1, max_n + 1)]
    log_mean = reduce(lambda a, b: a + b, [
        F.log(c.cast("double") / t) / max_n for c, t in zip(clipped, totals)])
    c, r = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    any_zero = reduce(lambda a, b: a | b, [x == 0 for x in clipped])
    bleu = F.when(any_zero, F.lit(0.0)).otherwise(bp * F.exp(log_mean))
    return stats.select(bleu.alias("bleu"), *[
        F.when(t > 0, x / t).alias(f"precision_{i}") for i, (x, t) in enumerate(zip(clipped, totals), 1)],
        "hyp_len", "ref_len")


def bleu(df: DataFrame, key_cols, hyp_col, ref_col, max_n: int = MAX_N, partitions: int | None = None) -> DataFrame:
    """One row: corpus BLEU-4, the four precisions and both lengths."""
    return bleu_from_stats(bleu_stats(df, key_cols, hyp_col, ref_col, max_n, partitions), max_n)


def word_edit_distance(hyp_words, ref_words) -> Column:
    """Levenshtein distance over the words of two word arrays."""
    return word_distance(_c(hyp_words), _c(ref_words))


def sentence_errors(df: DataFrame, key_cols, hyp_col, ref_col, partitions: int | None = None) -> DataFrame:
    """Per pair: character and word edit counts and reference lengths
    (a missing hypothesis counts as an empty string). Texts of any length:
    memory grows with a text, not with the product of the two."""
    e = spread_rows(df, partitions).select(*key_cols, text_errors(_text(hyp_col), _text(ref_col)).alias("_e"))
    return e.select(*key_cols, "_e.*")


def cer(df: DataFrame, hyp_col, ref_col, partitions: int | None = None) -> DataFrame:
    """One row: character edit operations over reference characters."""
    h, r = _text(hyp_col), _text(ref_col)
    e = spread_rows(df, partitions).select(char_distance(h, r).alias("_e"), F.length(r).alias("_n"))
    return e.agg((F.sum("_e") / F.sum("_n")).alias("cer"))


def wer(df: DataFrame, hyp_col, ref_col, partitions: int | None = None) -> DataFrame:
    """One row: word edit operations over reference words."""
    hw, rw = whitespace_words(_text(hyp_col)), whitespace_words(_text(ref_col))
    e = spread_rows(df, partitions).select(hw.alias("_h"), rw.alias("_r"))
    e = e.select(word_edit_distance("_h", "_r").alias("_e"), F.size("_r").alias("_n"))
    return e.agg((F.sum("_e") / F.sum("_n")).alias("wer"))


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine single-row aggregates into one row without a join: union
    with missing columns as null, then keep each column's value."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.agg(*[F.first(c, ignorenulls=True).alias(c) for c in merged.columns])


def corpus_scores(predictions: DataFrame, key_cols=("id",), hyp_col: str = "prediction",
                  ref_col: str = "reference", partitions: int | None = None) -> DataFrame:
    """One row with BLEU, CER, WER and the number of decoded rows; the
    predictions are spread once and read by both computations."""
    predictions = spread_rows(predictions, partitions)
    e = sentence_errors(predictions, key_cols, hyp_col, ref_col)
    errors = e.agg((F.sum("char_errors") / F.sum("ref_chars")).alias("cer"),
                   (F.sum("word_errors") / F.sum("ref_words")).alias("wer"),
                   F.count(F.lit(1)).alias("decoded_test_examples"))
    return one_row(bleu(predictions, key_cols, hyp_col, ref_col, partitions=partitions).select("bleu"), errors)


def test_results(test_loss: DataFrame, scores: DataFrame, all_test: DataFrame,
                 best: DataFrame, run_id: str, checkpoint: str = "best.pt") -> DataFrame:
    """The results row of one run: test loss over all test rows, metrics over
    the decoded ones, counts, the checkpoint name and the run's best epoch
    (``best`` may hold many runs)."""
    row = one_row(test_loss.select(F.col("loss").alias("test_loss")),
                  scores.select("bleu", "cer", "wer", "decoded_test_examples"),
                  all_test.agg(F.count(F.lit(1)).alias("all_test_examples")),
                  best.where(F.col("run_id") == run_id).select("best_epoch"))
    return row.select("test_loss", "bleu", "cer", "wer",
                      F.col("decoded_test_examples").cast("bigint"),
                      F.col("all_test_examples").cast("bigint"),
                      F.lit(checkpoint).alias("checkpoint"), F.col("best_epoch").cast("int"))
