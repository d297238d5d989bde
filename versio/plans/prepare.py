"""Data preparation of one experiment as one lazy plan:
pairs → seeded split → train-only vocabularies → length filter → encode →
fixed-length model inputs."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encoding import encode
from ..operators.inputs import length_filter, model_inputs
from ..operators.sampling import split_train_val_test
from ..operators.vocab import materialize_vocab, train_vocab
from ..sources.pairs import project_lang


@dataclass
class Prepared:
    split: DataFrame        # id, split, split_key, selected, total, src_text, tgt_text
    vocab: DataFrame        # lang, token, id
    kept: DataFrame         # split rows that fit seq_len
    encoded: DataFrame      # kept + src_ids, tgt_ids
    inputs: DataFrame       # model inputs


def split_pairs(pairs: DataFrame, seed: int = 42, max_samples: int | None = None,
                src: str = "en", tgt: str = "it") -> DataFrame:
    """``(id, src_text, tgt_text[, row_key])`` with the seeded split columns."""
    keep = ["row_key"] if "row_key" in pairs.columns else []
    flat = pairs.select("id", project_lang(pairs, src, "src_text"), project_lang(pairs, tgt, "tgt_text"), *keep)
    return split_train_val_test(flat, seed, max_samples)


def prepare(pairs: DataFrame, seed: int = 42, max_samples: int | None = None, seq_len: int = 128,
            src: str = "en", tgt: str = "it", with_decoder_mask: bool = True,
            vocab: DataFrame | None = None, split: DataFrame | None = None) -> Prepared:
    """Build the plan. The split is two boundary keys found when it is built
    and a comparison in each row, so the vocabulary, the length filter and the
    encoder each read the source again and nothing is sorted or rewritten."""
    if split is None:
        split = split_pairs(pairs, seed, max_samples, src, tgt)
    if vocab is None:
        vocab = materialize_vocab(train_vocab(split, {src: "src_text", tgt: "tgt_text"}), [src, tgt])
    kept = length_filter(split, seq_len)
    encoded = encode(kept, ["id"], {"src_ids": ("src_text", src), "tgt_ids": ("tgt_text", tgt)}, vocab)
    inputs = model_inputs(encoded, seq_len, with_decoder_mask=with_decoder_mask)
    return Prepared(split, vocab, kept, encoded, inputs)
