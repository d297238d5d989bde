"""Decontamination against a brute-force version, and its edge cases."""

import random
import re

import pytest

from versio.llm import decontamination as D


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, span=13):
    out = {}
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(span, len(b))
            wins = {tuple(b[a:a + n]) for a in range(len(b) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a:a + n]) in wins:
                    hit.update(range(a, a + n))
                    ids.add(item)
        out[i] = (len(w), len(hit), sorted(x for x in ids if x is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: (r["contamination"]["n_words"], r["contamination"]["n_hit"],
                          sorted(x for x in r["contamination"]["items"] if x is not None),
                          r["contamination"]["contaminated"]) for r in D.contamination(d, b).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """A small alphabet of words gives repeated grams, ties and partial runs."""
    rnd = random.Random(seed)
    voc = ["a", "b", "c", "É", "né", "X1", "z"] if seed == 1 else ["the", "Of", "on"]
    items = [(i, " ".join(rnd.choices(voc, k=rnd.choice([1, 3, 5, 6, 12, 13, 14, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (20, items[5][1] + "!"), (21, None), (22, " ... "), (None, " ".join(rnd.choices(voc, k=20)))]
    docs = []
    for i in range(40):
        body = rnd.choices(voc, k=rnd.randint(0, 60))
        if rnd.random() < 0.6:
            t = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(t) - 5))
            body[5:5] = t[a:a + rnd.randint(10, 40)]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(body)))
    docs += [(100, None), (101, ""), (102, "!?")]
    assert found(spark, docs, items) == brute(docs, items)


def test_edge_cases(spark):
    """Empty tables, repeated rows, null ids, clashing extra columns, long texts."""
    item = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i % 977}" for i in range(120_000)) + " " + item
    docs = [(1, item), (1, item), (None, "so " + item), (2, long), (3, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS items", "1 AS row", "2 AS span")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["contamination"]["n_hit"], r["contamination"]["contaminated"], r["items"])
                 for r in D.contamination(df, bench).collect())
    assert got == [("1", 40, True, "x"), ("1", 40, True, "x"), ("2", 40, False, "x"), ("3", 0, False, "x"), ("None", 40, True, "x")]
    assert sorted(r["doc_id"] for r in D.keep_clean(df, bench).collect()) == [2, 3]
    assert D.keep_clean(df, bench).columns == df.columns
    assert D.keep_clean(df, bench.where("false")).count() == 5
    assert D.contamination(df.where("false"), bench).count() == 0


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame([(9, "some words")], "item_id long, text string")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = D.contamination(df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
