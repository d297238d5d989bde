import regex

from versio.functions.text import encode_tokens, pre_tokenize, whitespace_words
from versio.operators.encoding import decode_texts, encode_ids, oov_rate
from versio.operators.vocab import build_vocab, specials, vocab_size, word_counts
from versio.schemas import VOCAB

EDGE = ["", "   ", "([SOS]", "a[PAD]b..[EOS]!", "[[SOS]]", "«Sì; è»", "naïve_x 12½ ⅷ",
        "a b", "x‍y", "漢字かな交じり", "emoji 😀 ok", "Hello, world!"]


def test_pre_tokenize_matches_unicode_word_regex(spark):
    df = spark.createDataFrame([(t,) for t in EDGE], "t string")
    got = [r.toks for r in df.select(pre_tokenize("t").alias("toks")).collect()]
    want = [regex.findall(r"\w+|[^\w\s]+", t) for t in EDGE]
    assert got == want


def test_encode_tokens_keep_literal_specials(spark):
    df = spark.createDataFrame([(t,) for t in ["([SOS]", "[[SOS]]", "a[PAD]b..[EOS]!", "ab[UNK]cd"]], "t string")
    got = [r.toks for r in df.select(encode_tokens("t").alias("toks")).collect()]
    assert got == [["(", "[SOS]"], ["[", "[SOS]", "]"], ["a", "[PAD]", "b", "..", "[EOS]", "!"],
                   ["ab", "[UNK]", "cd"]]


def test_whitespace_words_like_str_split(spark):
    texts = ["a  b\tc\n", " x\x0by\x1cz ", "", "one two　three"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.w for r in df.select(whitespace_words("t").alias("w")).collect()]
    assert got == [t.split() for t in texts]


def test_vocab_order_cap_and_min_frequency(spark):
    text = "b b a a c c c d e e z z"
    df = spark.createDataFrame([(1, text), (2, "y y")], "id long, t string")
    vocab = build_vocab(word_counts(df, {"xx": "t"}), ["xx"], cap=8)
    got = sorted((r.id, r.token) for r in vocab.collect())
    assert got == [(0, "[UNK]"), (1, "[PAD]"), (2, "[SOS]"), (3, "[EOS]"),
                   (4, "c"), (5, "a"), (6, "b"), (7, "e")]
    assert vocab_size(vocab).first().vocab_size == 8


def _toy_vocab(spark):
    src = ["we", "they", "read", "books", "maps"]
    tgt = ["noi", "loro", "leggono", "libri", "mappe"]
    rows = [(lang, w, i + 4) for lang, ws in (("en", src), ("it", tgt)) for i, w in enumerate(ws)]
    return specials(spark, ["en", "it"]).unionByName(spark.createDataFrame(rows, VOCAB))


def test_encode_decode_smoke_pairs(spark):
    vocab = _toy_vocab(spark)
    pairs = spark.createDataFrame([(1, "we read books", "noi leggono libri"), (2, "they read maps", "loro leggono mappe"),
                                   (3, "", "leggono old scrolls")], "id long, src string, tgt string")
    enc = encode_ids(pairs, ["id"], {"s": ("src", "en"), "t": ("tgt", "it")}, vocab)
    got = {r.id: (r.s, r.t) for r in enc.collect()}
    assert got[1] == ([4, 6, 7], [4, 6, 7])
    assert got[2] == ([5, 6, 8], [5, 6, 8])
    assert got[3] == ([], [6, 0, 0])
    dec = {r.id: r.text for r in decode_texts(enc, ["id"], "t", vocab, "it").collect()}
    assert dec == {1: "noi leggono libri", 2: "loro leggono mappe", 3: "leggono"}
    rate = oov_rate(enc, [], ["t"]).first()
    assert rate.t_unk == 2 and rate.t_tokens == 9


def test_decode_drops_specials_and_unknown_ids(spark):
    vocab = _toy_vocab(spark)
    df = spark.createDataFrame([(1, [2, 4, 0, 1, 3, 99, 5])], "id long, ids array<int>")
    assert decode_texts(df, ["id"], "ids", vocab, "it").first().text == "noi loro"


def test_word_counts_one_pass_for_languages(spark):
    df = spark.createDataFrame([("a b", "c c")], "x string, y string")
    got = sorted((r.lang, r.token, r["count"]) for r in word_counts(df, {"en": "x", "it": "y"}).collect())
    assert got == [("en", "a", 1), ("en", "b", 1), ("it", "c", 2)]
