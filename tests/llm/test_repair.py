"""Conversation repair against a brute-force version, and its edge cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from versio.llm import repair as R
from versio.llm.queries import damaged, registry

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, letters) of (role, fault) rows by full recursion over all edits,
    with the repaired (row or None, role) list."""
    @lru_cache(None)
    def best(i, kept, inserts):
        """kept: '' or the last role's initial."""
        given = "a" if kept == "u" else "u"
        out = [(0, "", ())] if i == len(rows) and kept in ("", "a") else []
        if inserts < 3:
            c, s, p = best(i, given, inserts + 1)
            out.append((c + 3, "I" + s, ((None, given), *p)))
        if i < len(rows):
            role, fault = rows[i]
            c, s, p = best(i + 1, kept, 0)
            out.append((c + 4, "D" + s, p))
            if fault in (None, "truncated"):
                extra = 3 if fault else 0
                c, s, p = best(i + 1, given, 0)
                out.append((c + 3 + extra, "R" + s, ((i, given), *p)))
                if role[:1] == given or role[:1] == "s" and kept == "":
                    c, s, p = best(i + 1, role[:1], 0)
                    out.append((c + extra, "K" + s, ((i, None), *p)))
        return min(out, key=lambda x: x[:2]) if out else (10 ** 9, "", ())
    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for kept in ("", "s", "u", "a"):
            best(i, kept, 0)
    return best(0, "", 0)


def brute(turns):
    """conv_id -> the contract's columns, of (conv_id, turn, role, text) rows."""
    convs = {c: [] for c, *_ in turns}
    for c, t, role, text in turns:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            convs[c] += [row] * (2 if kind == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else
                          "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, kept = cheapest(tuple((r[1], f) for r, f in zip(rows, faults)))
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name.get(g) or rows[i][1]}:{'' if i is None else rows[i][2]}" for i, g in kept]
        numbers = [t for t, *_ in rows if t is not None]
        out[c] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
                  *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
                  cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows, done = R.repair(damaged(df), copies_col="copies")
    return {r[0]: tuple(r)[1:] for r in R.report(rows, done, df).collect()}


def dialogues(seed, n, longest, roles=("user", "assistant", "user", "assistant", "system", "tool", None, "")):
    rnd, out = random.Random(seed), []
    texts = ["Yes.", "No!", "Cut off here", "  ", "", None, "Why? ", "é…", "Well.\n"]
    for c in range(n):
        for t in range(rnd.randint(0, longest)):
            role = ("user", "assistant")[t % 2] if rnd.random() < 0.7 else rnd.choice(roles)
            out.append((rnd.choice([c, c, c, None]) if c % 9 == 0 else c, t if rnd.random() < 0.9 else rnd.choice([None, t - 1]),
                        role, rnd.choice(texts) if rnd.random() < 0.4 else f"Sentence {rnd.random()}."))
    return out


KIND = "conv_id long, turn long, role string, text string"


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = registry()["op13_ida_star_repair"][0](spark, sf)
    assert [k for _, k in out.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute(rows)


@pytest.mark.parametrize("segment", [64, 3])
def test_any_length_of_segment(spark, monkeypatch, segment):
    """Cuts of a conversation do not change its repair, over several levels of combining."""
    monkeypatch.setattr(R, "SEGMENT", segment)
    monkeypatch.setattr(R, "FAN", 2 if segment == 3 else 256)
    rows = dialogues(1, 40, 30)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert got(df) == brute(rows)


def test_edge_cases(spark):
    """Nulls in every column, repeated rows, blanks only, clashing extra columns, one long conversation."""
    rows = [(None, None, None, None)] * 3 + [(1, 5, "user", "Hi.")] * 4 + [(2, 0, "system", " \n")] * 2
    rows += [(3, i, ("user", "assistant")[i % 2], f"Word {i}" + "." * (i % 3)) for i in range(400)] + [(4, None, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, KIND)
    extra = df.selectExpr("*", "1 as pos", "2 as copies", "3 as seg").drop("copies")
    assert got(extra) == brute(rows) == got(df)
    assert got(df.where("false")) == {}
    assert brute([(7, 1, "user", "a")]).keys() == got(spark.createDataFrame([(7, 1, "user", "a")], KIND)).keys()


def test_all_rows_dropped(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(8, gone, "user", "Hi.")], KIND)
    assert got(df) == {8: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} == brute([(8, gone, "user", "Hi.")])


def test_search_finds_the_least_letters():
    rnd = random.Random(3)
    names = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for _ in range(3000):
        rows = [(rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice([None, None, *names])) for _ in range(rnd.randint(0, 9))]
        cost, _, letters, _ = R.search("".join(r[:1] for r, _ in rows), [names[f] for _, f in rows], 0, None)
        assert (cost, "".join(letters)) == cheapest(tuple(rows))[:2]
