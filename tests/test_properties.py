"""Property-based checks (hypothesis) on small random inputs."""


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from versio.operators.encoding import decode_texts, encode_ids
from versio.operators.metrics import bleu, sentence_errors
from versio.operators.rank import exact_rank
from versio.operators.vocab import build_vocab, word_counts

SETTINGS = settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))

WORDS = st.sampled_from(["il", "gatto", "nero", "dorme", "sul", "tetto", "e", "sogna", ",", "."])
SENTENCE = st.lists(WORDS, min_size=0, max_size=12).map(" ".join)


def _ed(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@SETTINGS
@given(st.lists(st.integers(0, 20), min_size=1, max_size=300), st.integers(1, 9))
def test_rank_is_the_sorted_position(spark, keys, parts):
    rows = [(i, k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, k long")
    got = {r.id: r["rank"] for r in exact_rank(df, ["k", "id"], num_partitions=parts).collect()}
    want = {i: pos for pos, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1)}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(SENTENCE, SENTENCE), min_size=1, max_size=15))
def test_edit_counts_match_brute_force(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id long, h string, r string")
    got = {x.id: (x.char_errors, x.word_errors) for x in sentence_errors(df, ["id"], "h", "r").collect()}
    for i, (h, r) in enumerate(pairs):
        assert got[i] == (_ed(h, r), _ed(h.split(), r.split()))


@SETTINGS
@given(st.lists(SENTENCE.filter(lambda s: len(s.split()) >= 4), min_size=1, max_size=8))
def test_bleu_of_identical_corpus_is_one(spark, texts):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id long, h string, r string")
    assert abs(bleu(df, ["id"], "h", "r").first().bleu - 1.0) < 1e-12


@SETTINGS
@given(st.lists(SENTENCE, min_size=2, max_size=15))
def test_decode_of_encode_keeps_known_tokens(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    vocab = build_vocab(word_counts(df, {"it": "t"}), ["it"], cap=8)
    known = {r.token for r in vocab.collect() if r.id > 3}
    for method in ("lookup", "join"):
        enc = encode_ids(df, ["id"], {"ids": ("t", "it")}, vocab, method=method)
        dec = {r.id: r.text for r in decode_texts(enc, ["id"], "ids", vocab, "it", method=method).collect()}
        for i, t in enumerate(texts):
            assert dec[i] == " ".join(w for w in t.split() if w in known)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["en", "it"]), st.integers(0, 60), st.integers(1, 6)),
                min_size=1, max_size=120, unique_by=lambda t: (t[0], t[1])),
       st.integers(5, 40))
def test_vocab_threshold_cut_equals_plain_top_k(spark, rows, cap):
    counts = spark.createDataFrame([(lang, f"w{tok:02d}", c) for lang, tok, c in rows],
                                   "lang string, token string, count long")
    got = sorted((r.lang, r.token, r.id) for r in build_vocab(counts, ["en", "it"], cap=cap).collect() if r.id > 3)
    want = []
    for lang in ("en", "it"):
        cand = sorted(((-c, f"w{tok:02d}") for lg, tok, c in rows if lg == lang and c >= 2))
        want += [(lang, tok, i + 4) for i, (_, tok) in enumerate(cand[:cap - 4])]
    assert got == sorted(want)
