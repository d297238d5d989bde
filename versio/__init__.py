"""versio — parallel-corpus preparation and translation evaluation on Spark.

The main entry points; every module under ``versio.operators`` can also be
used on its own.
"""

from .operators.encoding import decode, encode, oov_rate
from .operators.history import best_epoch, epoch_summary, learning_curve, resume_point, with_progress
from .operators.hypotheses import assemble_hypotheses, greedy_pick, score_corpus, truncate_hypothesis
from .operators.inputs import length_filter, length_filter_report, model_inputs, prompt_input
from .operators.losses import cross_entropy, epoch_loss, running_loss
from .operators.manifest import data_manifest, manifest_diff, manifest_long
from .operators.metrics import bleu, cer, corpus_scores, sentence_errors, wer
from .operators.rank import exact_rank, running_sums
from .operators.sampling import epoch_batches, eval_limit, sample_n, seeded_shuffle, split_train_val_test
from .operators.vocab import build_vocab, load_or_train_vocab, train_vocab, vocab_size, word_counts
from .plans.evaluate import evaluate, translate
from .plans.experiment import prepare_run
from .plans.prepare import prepare
from .sources.files import file_digests, read_history, read_predictions, verify_checksum, write_predictions
from .sources.pairs import pairs_from_conversations, read_pairs

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python functions of this package that run in tasks (the progress
    stream's state update, model factories) are pickled by value, so
    executors never need the package on their own path."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except (ImportError, ValueError):  # already registered, or no pyspark
        pass


_ship_by_value()

__all__ = [
    "assemble_hypotheses", "best_epoch", "bleu", "build_vocab", "cer", "corpus_scores", "cross_entropy",
    "data_manifest", "decode", "encode", "epoch_batches", "epoch_loss", "epoch_summary", "eval_limit",
    "evaluate", "exact_rank", "file_digests", "greedy_pick", "learning_curve", "length_filter",
    "length_filter_report", "load_or_train_vocab", "manifest_diff", "manifest_long", "model_inputs",
    "oov_rate", "pairs_from_conversations", "prepare", "prepare_run", "prompt_input", "read_history",
    "read_pairs", "read_predictions", "resume_point", "running_loss", "running_sums", "sample_n",
    "score_corpus", "seeded_shuffle", "sentence_errors", "split_train_val_test", "train_vocab", "translate",
    "truncate_hypothesis", "verify_checksum", "vocab_size", "wer", "with_progress", "word_counts",
    "write_predictions",
]
