"""Perspective rotation against a plain version, and its edge cases."""

import random

from versio.llm import chat as C


def plain(rows):
    """(conv, perspective) -> (dialogue, masked strings in order)."""
    rows = sorted(set((c, t, s, x or "") for c, t, s, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
    out = {}
    for conv, me in {(c, s) for c, _, s, _ in rows if s not in (None, "system")}:
        text, masked = "", []
        for c, _, s, x in rows:
            if c != conv:
                continue
            esc = lambda v: v.replace("<|", "< |")
            head = "<|assistant|>\n" if s == me else "<|system|>\n" if s == "system" else \
                "<|user|>\n" if s is None else f"<|user name={esc(s)}|>\n"
            text += head + esc(x) + C.END
            if s == me:
                masked.append(esc(x) + C.END)
        out[(conv, me)] = (text, masked)
    return out


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["block"]):
        text, masked = out.get((r["conv_id"], r["perspective"]), ("", []))
        out[(r["conv_id"], r["perspective"])] = (text + r["text"], masked + [
            r["text"][a:b] for a, b in zip(r["mask_starts"], r["mask_ends"], strict=True)])
    return out


def test_against_plain_version(spark, monkeypatch):
    rnd, rows = random.Random(6), []
    for c in list(range(12)) + [None]:
        for t in range(rnd.randint(1, 200)):
            rows.append((c, rnd.choice([t, t, t - 1, None]), rnd.choice(["ann", "bob", "<|x", "system", None, "É"]),
                         rnd.choice([f"say {t}", "", None, "a <|end|> b", "ñ🙂"])))
    rows += rows[:20] + [(99, 0, "system", "alone"), (98, 0, None, "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS block", "1 AS part")
    out = C.rotate(df.repartition(5))
    assert joined(out) == plain(rows)
    counts = {}
    for r in out.collect():
        counts[r["conv_id"], r["perspective"]] = counts.get((r["conv_id"], r["perspective"]), 0) + r["n_rows"]
    assert all(v == sum(x[0] == c for x in rows) for (c, _), v in counts.items())


def test_one_rule_at_all_sizes(spark):
    """Conversations with very many rows of one turn number, also around the old bounds."""
    rows = [(n, 3, "ann" if i % 2 else "bob", f"tie {i}") for n in (63, 64, 65, 1000, 1100) for i in range(n - 2)]
    rows += [(n, t, "bob", x) for n in (63, 64, 65, 1000, 1100) for t, x in ((2, "before"), (4, "after"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.rotate(df.repartition(3))
    assert joined(out) == plain(rows)
    sizes = {}
    for r in out.collect():
        sizes.setdefault((r["conv_id"], r["perspective"]), {})[r["block"]] = r["n_turns"]
    for (n, _), blocks in sizes.items():
        assert [blocks[b] for b in sorted(blocks)] == [64] * (n // 64) + ([n % 64] if n % 64 else [])


def test_sql_of_null_ids_and_ties(spark, tmp_path):
    """The registered SQL gives the same rows where ids and turns are null and rows repeat."""
    import duckdb

    from versio.llm import oracles as O
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([None, 0, 1, 2]), rnd.choice(["ann", "bob", "system", None]), rnd.choice(["a", "b", None, f"t {i}"]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    want = con.sql(O.CHAT)
    got = C.rotate(df).select(*want.columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = C.rotate(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
