"""Blocked, banded edit distances against the plain dynamic programme."""

import random
import time
import tracemalloc

import pytest

from versio.functions import edit as E
from versio.operators import metrics as X


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize(("block", "band"), [(4096, 512), (3, 2), (5, 1), (1, 1), (7, 4)])
def test_against_the_plain_programme(monkeypatch, block, band):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "BAND", band)
    rnd = random.Random(block)
    for _ in range(800):
        a = [rnd.randrange(4) for _ in range(rnd.randint(0, 25))]
        b = ([rnd.randrange(4) for _ in range(rnd.randint(0, 25))] if rnd.random() < 0.5
             else [x if rnd.random() < 0.8 else rnd.randrange(4) for x in a if rnd.random() < 0.9])
        assert E.edit_distance(a, b) == plain(a, b)


def test_long_pair_is_quick_and_small():
    rnd = random.Random(3)
    a = [f"w{rnd.randrange(20_000)}" for _ in range(16_000)]
    b = [w if rnd.random() < 0.9 else "other" for w in a if rnd.random() < 0.95]
    codes = E.word_codes(a, b)
    assert 1000 < E.edit_distance(*codes) < 3500
    tracemalloc.start()
    t = time.perf_counter()
    E.edit_distance(*codes)
    assert time.perf_counter() - t < 30  # some 3 s when traced
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    # the same text with one word put in front: a narrow band is enough
    assert E.edit_distance(codes[0], [99_999, *codes[0]]) == 1


def test_errors_of_pairs(spark):
    rows = [(1, "a b c", "a x c"), (2, None, "one two"), (3, "é\U0001f600 b", "é b"), (4, "", ""), (5, "same", "same"), (6, "a b c", None),
            (7, "word " * 3000, "word " * 2990 + "other")]
    df = spark.createDataFrame(rows, "id int, h string, r string")
    got = {r["id"]: tuple(r)[1:] for r in X.sentence_errors(df, ["id"], "h", "r").collect()}
    for i, h, r in rows[:-1]:
        h, r = h or "", r or ""
        assert got[i] == (plain(h, r), len(r), plain(h.split(), r.split()), len(r.split()))
    assert got[7][2:] == (10, 2991)
    few = df.where("id < 7")
    pairs = [(h or "", r or "") for _, h, r in rows[:-1]]
    assert X.cer(few, "h", "r").first()[0] == pytest.approx(sum(plain(h, r) for h, r in pairs) / sum(len(r) for _, r in pairs))
    assert X.wer(few, "h", "r").first()[0] == pytest.approx(
        sum(plain(h.split(), r.split()) for h, r in pairs) / sum(len(r.split()) for _, r in pairs))
