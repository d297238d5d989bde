"""SimHash groups against brute force, crowded index entries, and edge cases."""

import random
import re

import xxhash

from versio.llm import common as C
from versio.llm import simhash as S
from versio.llm.common import connected_components


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute(rows, bits=2):
    fps = {i: fingerprint(t) for i, t in rows}
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, f"{fps[i]:016x}", find(i)) for i in fps)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in S.simhash_groups(docs.repartition(4)).collect())
    assert got == brute([tuple(r) for r in docs.collect()])
    kept = S.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in got if i == c]


def test_links_with_crowded_entries(spark):
    """The same links whether or not entries are indexed further, for 2 and 3 bits."""
    rnd, fps = random.Random(3), set()
    for _ in range(5):
        base = rnd.getrandbits(64)
        for _ in range(80):
            x = base
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(S._signed(x))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bits, bucket in ((2, 128), (2, 4), (3, 16)):
        got = {tuple(r) for r in S.near_links(df, bits, bucket).collect()}
        assert got == {(max(a, b), min(a, b)) for a in fps for b in fps if a != b and ((a ^ b) % 2**64).bit_count() <= bits}


def test_edge_cases(spark):
    """Null, empty and very long texts, null ids, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 999}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, long), (6, long), (7, long + " w"), (None, "one two"),
            (None, "alone here now then")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component_id")
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_groups(df).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1)} <= got
    assert {c for i, _, c in got if i in (4, 5)} == {4} and {c for i, _, c in got if i in (6, 7)} == {6}
    assert {c for i, _, c in got if i is None} == {4, None} and S.simhash_groups(df).count() == 10
    assert all(fp == f"{fingerprint(t):016x}" for i, t in rows[3:5] for j, fp, _ in got if j == i)
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "None", "None"]
    assert S.simhash_groups(df.where("false")).count() == 0


def test_one_id_with_different_texts(spark):
    """Documents are dropped by id and text: the group of the second text keeps one."""
    a, b = "first text of four", "another one with other words"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (2, b)], "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in S.keep_first(df).collect()) == [(1, a), (2, b)]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(2, 60)] + [(7, 1), (3, 3)]
    df = spark.createDataFrame(chain + hub + [(-5, -9)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)} | {-5: -9, -9: -9}
    assert connected_components(df.where("false")).count() == 0


def test_mark_of_many_edges(spark):
    """The change mark of components does not overflow (a long does at 2^24 edges)."""
    from versio.llm.common import edge_mark
    n, s = edge_mark(spark.range(20_000_000).selectExpr("id AS u", "id + 1 AS v"))
    assert n == 20_000_000 and s > 1 << 63


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_entries_are_not_broadcast(spark, scratch):
    """Spark sizes a written table by its files and leaves out what an explode adds."""
    spark.range(300).selectExpr("xxhash64(id) AS fp", "id AS first").write.parquet(f"{scratch}/nodes")
    nodes = spark.read.parquet(f"{scratch}/nodes")
    assert "Broadcast" not in plan(S.near_links(nodes, 2)) and "SortMergeJoin" in plan(S.near_links(nodes, 2))


def test_only_proven_sides_are_broadcast(spark, monkeypatch):
    """Beyond the bounds a side shuffles, however small its files look; so do many edges."""
    few, many = (spark.range(9).join(C.checked_broadcast(spark.range(5), n), "id") for n in (5, 4))
    assert "BroadcastHashJoin" in plan(few) and "Broadcast" not in plan(many)
    sides, shuffled = [], C.not_broadcast
    monkeypatch.setattr(C, "not_broadcast", lambda df: sides.append(df.columns) or shuffled(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    assert {r["root"] for r in connected_components(edges).collect()} == {0} and not sides
    monkeypatch.setattr(C, "BROADCAST_ROWS", 4)
    assert {r["root"] for r in connected_components(edges).collect()} == {0} and sides
