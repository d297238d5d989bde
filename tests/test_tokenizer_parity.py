"""Cross-check against the word-level tokenizer library the experiment
used (test-only; skipped when the package is not installed)."""

import pytest

from versio.operators.encoding import decode_texts, encode_ids
from versio.operators.vocab import build_vocab, word_counts
from versio.schemas import SPECIAL_TOKENS

tokenizers = pytest.importorskip("tokenizers")

SF01 = "/root/testdata/sf0.01"


def _library_tokenizer(texts):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import WordLevelTrainer

    tok = Tokenizer(WordLevel(unk_token="[UNK]"))
    tok.pre_tokenizer = Whitespace()
    tok.train_from_iterator(texts, trainer=WordLevelTrainer(special_tokens=SPECIAL_TOKENS, min_frequency=2))
    return tok


def test_vocabulary_encode_decode_match_library(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    lib = _library_tokenizer([r.text for r in rows])
    ours = build_vocab(word_counts(docs, {"doc": "text"}), ["doc"])
    assert {r.token: r.id for r in ours.collect()} == lib.get_vocab()  # includes the 30,000 cap

    enc = encode_ids(docs, ["doc_id"], {"ids": ("text", "doc")}, ours)
    got = {r.doc_id: r.ids for r in enc.collect()}
    dec = {r.doc_id: r.text for r in decode_texts(enc, ["doc_id"], "ids", ours, "doc").collect()}
    for r in rows:
        ids = lib.encode(r.text).ids
        assert got[r.doc_id] == ids
        assert dec[r.doc_id] == lib.decode(ids)


def test_literal_special_tokens_match_library(spark):
    texts = ["([SOS]", "a[PAD]b..[EOS]!", "[[SOS]]", "x [UNK] y", "«Sì; è»", ""]
    lib = _library_tokenizer(texts * 2)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    vocab = build_vocab(word_counts(spark.createDataFrame([(t,) for t in texts * 2], "t string"), {"x": "t"}), ["x"])
    assert {r.token: r.id for r in vocab.collect()} == lib.get_vocab()
    got = {r.id: r.ids for r in encode_ids(df, ["id"], {"ids": ("t", "x")}, vocab).collect()}
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t).ids, t
