"""The transducer against the public library, on the public model."""

import random

import pytest

from versio.llm import sentencepiece as S

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    spm = pytest.importorskip("sentencepiece")
    return spm.SentencePieceProcessor(model_file=MODEL)


def strange(n=300, seed=1):
    rnd = random.Random(seed)
    pool = list("  \n\t.,'-aeiothnsrlABCé ßñ日本🙂 ▁́" + "\x01") + ["the", "ing", " of", "   ", "tion", "http://"]
    return ["".join(rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(n)]


def test_same_ids_and_texts_as_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()] + strange() + ["", " ", "a" * 3000, "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    sp = S.SentencePiece(spark, MODEL)
    out = df.withColumn("ids", sp.encode(df["text"])).withColumn("back", sp.decode(S.F.col("ids"))).collect()
    assert len(out) == len(texts)
    checked = df.select("i", sp.encode_and_check(df["text"]).alias("p")).collect()
    assert {r["i"]: tuple(r["p"]) for r in checked} == {r["i"]: (r["ids"], True) for r in out}
    for r in out:
        want = library.encode(r["text"])
        assert r["ids"] == want, r["text"][:80]
        assert r["back"] == library.decode(want)
        assert r["back"] == r["text"].replace("▁", " ")


def test_one_path_is_finite(library):
    """Every prefix has one cheapest path, also where pieces compete."""
    t = S.Transducer(S.read_model(MODEL))
    for text in strange(100, seed=7):
        run = t.normalise(text).replace(" ", S.META)
        assert t.path(run) == library.encode(text)


def test_unigram_costs():
    """In a unigram model the path with the least sum of negated scores wins."""
    pieces = ["<unk>", "a", "b", "ab", "abc", "c", "bc", S.META]
    t = S.Transducer({"pieces": pieces, "scores": [0, -2, -2, -3, -9, -2, -2.5, -1], "kinds": [2] + [1] * 7,
                      "type": 1, "prefix": True, "trim": True})
    ids = lambda s: __import__("numpy").frombuffer(t.encode(s), "<i4").tolist()
    assert ids("abc") == [7, 1, 6]
    assert ids("  ab   c ") == [7, 3, 7, 5]
    assert ids("axyb") == [7, 1, 0, 2]
    assert t.decode(ids("ab c")) == "ab c"


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "", 2), (3, "x", 3)], "doc_id long, text string, pieces int")
    got = S.with_pieces(df, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["pieces"]) for r in got if r["text"] != "x") == [("2", []), ("2", []), ("None", None)]
    assert S.with_pieces(df.where("false"), MODEL).count() == 0
    sp = S.SentencePiece(spark, MODEL)
    ids = spark.createDataFrame([([None, 3 + 65],), (None,), ([],), ([10**6, -1],)], "ids array<int>")
    assert [r[0] for r in ids.select(sp.decode(ids["ids"])).collect()] == ["A", None, "", ""]
