"""Test evaluation as one plan: score the first test rows with a user
model, assemble and decode hypotheses, compute corpus metrics, and build
the results row together with the test loss and the best epoch."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hypotheses as Y
from ..operators import metrics as X
from ..operators.encoding import decode_column
from ..operators.history import best_epoch
from ..operators.inputs import model_inputs, prompt_input
from ..operators.sampling import eval_limit
from ..session import ensure_checkpoint_dir
from ..sources.files import write_predictions
from ..schemas import PAD_ID
from .prepare import Prepared


def echo_model():
    """Deterministic stand-in model for tests: the hypothesis is the source
    ids (``[SOS]`` … ``[EOS]`` kept, padding kept)."""
    import numpy as np

    def predict(inputs):
        return np.asarray(inputs, dtype=np.int32)

    return predict


def evaluate(prepared: Prepared, make_model, seq_len: int, eval_samples: int, tgt: str = "it",
             batch_size: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(predictions, scores)`` for the first ``eval_samples`` test rows
    (0 = all) in split order.

    The chosen rows are scored once: inputs, the model's ids and the decoded
    text are written as a table in the shared checkpoint folder, and predictions
    and metrics both read it. The model sees ``encoder_input`` and returns ids
    that start after ``[SOS]``; they are truncated at ``[EOS]`` / ``seq_len``.
    """
    test = model_inputs(prepared.encoded.where(F.col("split") == "test"), seq_len,
                        with_decoder_mask=False, extra_cols=("split", "split_key"))
    chosen = eval_limit(test, eval_samples)
    scored = Y.score_corpus(chosen, make_model, "encoder_input", "_raw", seq_len=seq_len, batch_size=batch_size)
    hyps = scored.withColumn("hypothesis", Y.truncate_hypothesis(F.slice("_raw", 2, seq_len), seq_len))
    decoded = decode_column(hyps, "hypothesis", prepared.vocab, tgt, "prediction")
    rows = decoded.select("id", F.col("src_text").alias("source"), F.col("tgt_text").alias("reference"), "prediction")
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scored-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    predictions = spark.read.schema(rows.schema).parquet(path)
    return predictions, X.corpus_scores(predictions)


def evaluate_run(spark, prepared: Prepared, run_dir: str, run_id: str, make_model, test_loss: DataFrame,
                 history: DataFrame, seq_len: int, eval_samples: int, tgt: str = "it") -> DataFrame:
    """The evaluation half of a run. Metrics cover the first ``eval_samples``
    filtered test rows, ``test_loss`` (one row with ``loss``) and the count all
    of them. Writes ``predictions/`` (CSV) and ``test_results/`` (JSON) under
    ``run_dir``, neither over an existing one, and returns the results row."""
    predictions, scores = evaluate(prepared, make_model, seq_len, eval_samples, tgt)
    all_test = prepared.kept.where(F.col("split") == "test")
    row = X.test_results(test_loss, scores, all_test, best_epoch(history), run_id)
    write_predictions(predictions, f"{run_dir}/predictions")
    row.write.mode("errorifexists").json(f"{run_dir}/test_results")
    return spark.read.schema(row.schema).json(f"{run_dir}/test_results")


def translate(texts: DataFrame, key_cols, text_col: str, vocab: DataFrame, make_model, seq_len: int,
              src: str = "en", tgt: str = "it", batch_size: int = 64) -> DataFrame:
    """Translate a table of texts: encode with the source vocabulary, score in
    Arrow batches, truncate at ``[EOS]`` and decode with the target vocabulary.
    Every text comes back with its ``status``; one that is null or longer than
    ``seq_len - 2`` tokens has a null translation. Narrow end to end: no shuffle."""
    inputs = prompt_input(texts, key_cols, text_col, vocab, src, seq_len, on_long="report")
    blank = F.array_repeat(F.lit(PAD_ID).cast("int"), seq_len)
    inputs = inputs.withColumn("encoder_input", F.coalesce("encoder_input", blank))
    scored = Y.score_corpus(inputs, make_model, "encoder_input", "_raw", seq_len=seq_len, batch_size=batch_size)
    hyps = scored.withColumn("hypothesis", Y.truncate_hypothesis(F.slice("_raw", 2, seq_len), seq_len))
    done = decode_column(hyps, "hypothesis", vocab, tgt, "translation")
    return done.select(*key_cols, text_col, "status", F.when(F.col("status") == "ok", F.col("translation")).alias("translation"))
