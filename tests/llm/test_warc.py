"""The WARC writer: round trips, determinism, commits and edge cases."""

import gzip
import hashlib
import pathlib
import random

import pytest

from versio.llm import warc as W

KIND = "page_id long, url string, html string"


def brute(rows, least=100):
    """Sorted (page_id, bytes, digest, type, refers_to) of (page_id, url, html) rows."""
    first, out = {}, []
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (html or "").encode()
        again = len(data) >= least and data in first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(out, key=str)


def got(df, **settings):
    out = W.archive(df, **settings)
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r["page"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]))
                   for r in out.collect()), key=str)


def pages(seed=1, n=300):
    rnd = random.Random(seed)
    texts = ["<p>" + rnd.choice("aé漢") * rnd.choice([5, 95, 100, 3000]) for _ in range(40)] + ["", None]
    return [(rnd.randrange(n) if rnd.random() < 0.95 else None, rnd.choice(["http://a/b c\r\nX: y", "http://é/", None, f"http://h/{i}"]),
             rnd.choice(texts)) for i in range(n)]


def files(folder):
    return {p.name: p.read_bytes() for p in pathlib.Path(folder).glob("*.warc.gz")}


@pytest.mark.parametrize("size", [1024, 7])
def test_against_brute_force(spark, size):
    """Nulls, copies, ties, odd urls, small payloads, in one shard and in many."""
    rows = pages()
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(df, shard_pages=size) == brute(rows)
    assert got(df.where("false"), shard_pages=size) == []


def test_texts_and_headers_come_back(spark, scratch):
    rows = pages(2, 60)
    W.write_warc(spark.createDataFrame(rows, KIND), scratch, shard_pages=20)
    back = [(r["page"], r["html"]) for r in W.read_warc(spark, scratch).where("record_type = 'response'").collect()]
    assert set(back) <= {(None if p is None else str(p), h or "") for p, _, h in rows}
    assert {h for _, h in back} == {h or "" for _, _, h in rows}
    seen, to = set(), set()
    for data in files(scratch).values():
        records = [W.parse_record(m) for m in W._members(__import__("io").BytesIO(data), hashlib.sha256())]
        assert records[0][0]["WARC-Type"] == "warcinfo" and gzip.decompress(data)
        for h, _ in records:
            assert h["WARC-Record-ID"] not in seen
            seen.add(h["WARC-Record-ID"])
            to |= {h["WARC-Refers-To"]} if h["WARC-Type"] == "revisit" else set()
    assert to and to <= seen


def test_same_files_from_any_partitions_and_rolls(spark, scratch):
    df = spark.createDataFrame(pages(3), KIND)
    settings = {"shard_pages": 50, "roll_bytes": 5000}
    W.write_warc(df.repartition(2), scratch + "a", **settings)
    W.write_warc(df.repartition(9), scratch + "b", **settings)
    a, b = files(scratch + "a"), files(scratch + "b")
    assert a == b and len(a) > 6
    listed = {r["name"]: (r["bytes"], r["sha256"]) for r in spark.read.parquet(scratch + "a/manifest").collect()}
    assert listed == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in a.items()}
    assert not [p for p in pathlib.Path(scratch + "a").iterdir() if p.name.startswith("_")]


def test_copies_of_one_page_are_spread(spark, scratch):
    rows = [(1, "u", "x" * 200)] * 95 + [(2, "u", "x" * 200), (3, "u", "y" * 20), (3, "u", "y" * 20)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert got(df, folder=scratch, shard_pages=10) == brute(rows)
    assert len(files(scratch)) == 10


def test_only_committed_files_count(spark, scratch):
    """A file of a lost attempt is not read; changed files and used folders are errors."""
    rows = pages(4, 50)
    df = spark.createDataFrame(rows, KIND)
    W.write_warc(df, scratch)
    (pathlib.Path(scratch) / "000009.000000-00000.warc.gz").write_bytes(b"half a reco")
    assert W.read_warc(spark, scratch).count() == 50
    with pytest.raises(FileExistsError):
        W.write_warc(df, scratch)
    one = next(pathlib.Path(scratch).glob("000000*.warc.gz"))
    one.write_bytes(one.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match=r"manifest|broken|incorrect"):
        W.read_warc(spark, scratch).collect()


def test_long_payload_extra_columns_and_string_ids(spark):
    rows = [("a%\n", "u", "é" * 2_000_000), ("b", "u", "é" * 2_000_000), ("b", None, None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").selectExpr("*", "1 as digest", "2 as bytes", "3 as kind")
    out = {(r["page"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in W.archive(df).collect()}
    assert out == {("a%\n", 4_000_000, "response", None), ("b", 4_000_000, "revisit", "a%\n"), ("b", 0, "response", None)}
