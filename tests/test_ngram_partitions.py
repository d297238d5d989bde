"""N-gram counts by partitions that grow with the texts."""

import re

from versio.operators import metrics as X
from versio.operators.partitioning import pieces


def test_pieces_grow_with_the_texts(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 200 + [(None,)], "text string")
    cores = spark.sparkContext.defaultParallelism
    assert pieces(df, "text", 1000) == max(cores, 200)
    assert pieces(df, "text", 10) == 20_000
    assert pieces(df.where("false"), "text", 10) == cores


def _exchanges(df):
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*, (\d+)\)", df._jdf.queryExecution().sparkPlan().toString()
                                       + df._jdf.queryExecution().executedPlan().toString())]


def test_groups_of_ngrams_are_dealt_to_the_partitions(spark):
    """More partitions than the session has: each holds that share of the groups."""
    rows = [(1, "a b a b c"), (1, "a b"), (None, "a b"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    few = {tuple(r) for r in X.ngram_counts(df, ["id"], "text").collect()}
    many = X.ngram_counts(df, ["id"], "text", partitions=37)
    assert {tuple(r) for r in many.collect()} == few and (1, 2, "a b", 3) in few and (None, 1, "a", 1) in few
    assert 37 in _exchanges(many)


def test_corpus_scores_are_dealt_to_the_partitions(spark):
    rows = [(1, "a b c d e", "a b c d f"), (1, "a b c d e", "a b c d e"), (None, None, "x"), (2, "", "")]
    df = spark.createDataFrame(rows, "id long, hyp string, ref string")
    few = X.corpus_scores(df, ["id"], "hyp", "ref").first()
    many = X.corpus_scores(df, ["id"], "hyp", "ref", partitions=37)
    assert many.first() == few and few.bleu > 0 and few.decoded_test_examples == 4
    stats = X.bleu_stats(df, ["id"], "hyp", "ref", partitions=37)
    assert 37 in _exchanges(stats) and stats.first() == X.bleu_stats(df, ["id"], "hyp", "ref").first()
