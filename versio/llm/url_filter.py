"""URL filter: rules first, then exact membership in a list by a Bloom cascade.

The keys of a URL are its host, the host's parent domains, and host with path.
Over all distinct keys of the corpus (its key universe) the listed ones are put
in a first Bloom filter; the unlisted keys that pass it go into a second one, the
listed keys that pass that into a third, and so on until none passes wrongly.
Walking the levels then answers membership exactly for every key of the universe,
without a join. Keys are dealt to shards by hash, and each shard has a cascade of
its own, so that no task builds more than a bounded part.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Shards at least, and keys that a shard holds on average at most.
MIN_SHARDS, SHARD_KEYS = 256, 50_000
#: Filters sent to the tasks at once; larger ones go in several passes.
PASS_BYTES = 64 << 20
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or
    has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the ``(pattern, verdict)`` rules that fits, as its pattern,
    else null. ``example.net/en/`` fits that host and its subdomains where the
    path starts with ``/en/``."""
    out = F.lit(None).cast("string")
    for pattern, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last match wins
        name, slash, tail = pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        out = F.when(fits, F.lit(pattern)).otherwise(out)
    return out


def keys_of(host: Column, path: Column) -> Column:
    """Array of a URL's keys: host, parent domains, and host with path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(domains, F.array(F.concat(host, path)))))


def _mixed(h: np.ndarray, salt) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        return x ^ (x >> np.uint64(31))


def _positions(h: np.ndarray, level: int, i: int, bits) -> np.ndarray:
    return _mixed(h, 64 * level + i + 1) % np.uint64(bits) if np.isscalar(bits) else _mixed(h, 64 * level + i + 1) % bits


def build_cascade(listed: np.ndarray, others: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Levels ``(bits, hashes, filter)`` for the 64-bit hashes of the listed and
    of all other keys. The first level's false positive rate makes the second
    about as large as needed; further levels halve."""
    levels, inside, outside = [], listed, others
    while len(inside):
        rate = 0.5 if levels else min(0.5, max(1e-6, math.sqrt(0.5) * len(inside) / max(1, len(outside))))
        k = max(1, round(-math.log2(rate)))
        bits = max(8, math.ceil(len(inside) * k / math.log(2)))
        field = np.zeros(bits, bool)
        for i in range(k):
            field[_positions(inside, len(levels), i, bits)] = True
        passed = np.ones(len(outside), bool)
        for i in range(k):
            passed &= field[_positions(outside, len(levels), i, bits)]
        levels.append((bits, k, np.packbits(field, bitorder="little").tobytes()))
        inside, outside = outside[passed], inside
    return levels


class Cascades:
    """The cascades of some shards, laid out for vectorised lookup."""

    def __init__(self, rows: list[tuple[int, int, int, int, bytes]], shards: int):
        depth = 1 + max((r[1] for r in rows), default=-1)
        self.bits, self.hashes = np.zeros((depth, shards), np.uint64), np.zeros((depth, shards), np.int64)
        self.start, self.field, at = np.zeros((depth, shards), np.int64), [], 0
        for shard, level, bits, k, raw in rows:
            self.bits[level, shard], self.hashes[level, shard], self.start[level, shard] = bits, k, at
            self.field.append(np.frombuffer(raw, np.uint8))
            at += len(raw) * 8
        self.field = np.concatenate(self.field) if self.field else np.zeros(1, np.uint8)
        self.depth = depth

    def contains(self, h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed: it is if it fails at a
        level of unlisted keys, or passes all and the last level is of listed keys."""
        answer = np.zeros(len(h), bool)
        open_ = np.arange(len(h))
        for level in range(self.depth):
            k = self.hashes[level, shard[open_]]
            ended = k == 0  # passed every level of its shard: listed after an odd number of them
            answer[open_[ended]] = level % 2 == 1
            open_, k = open_[~ended], k[~ended]
            passed, s = np.ones(len(open_), bool), shard[open_]
            for i in range(int(k.max(initial=0))):
                use = np.flatnonzero(passed & (k > i))
                at = _positions(h[open_[use]], level, i, self.bits[level, s[use]]).astype(np.int64) + self.start[level, s[use]]
                passed[use] = (self.field[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            answer[open_[~passed]] = level % 2 == 1
            open_ = open_[passed]
        answer[open_] = self.depth % 2 == 1
        return answer


def cascade_table(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """From all keys of the corpus and the listed keys (one column ``key``
    each): a written table ``shard, level, bits, hashes, filter`` and the number
    of shards. Listed keys that the corpus lacks are part of the universe too."""
    keys = universe.select("key", F.lit(0).alias("on")).unionByName(listed.select("key", F.lit(1).alias("on")))
    keys = materialize(keys.where("key is not null").groupBy(F.xxhash64("key").alias("h"), F.xxhash64("key", F.lit(1)).alias("at"))
                       .agg(F.max("on").alias("on")), "url-keys")
    shards = max(MIN_SHARDS, math.ceil(keys.count() / SHARD_KEYS))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h, on = pdf["h"].to_numpy().view(np.uint64), pdf["on"].to_numpy() == 1
        levels = build_cascade(h[on], h[~on])
        return pd.DataFrame([(key[0], n, *x) for n, x in enumerate(levels)], columns=["shard", "level", "bits", "hashes", "filter"])

    table = (keys.groupBy(F.pmod("at", F.lit(shards)).cast("int").alias("shard"))
             .applyInPandas(build, "shard int, level int, bits long, hashes int, filter binary"))
    return materialize(table, "url-cascade"), shards


def _judge(shared):
    """Task-side lookup: whether any of a row's keys is listed."""
    def judge(h: pa.Array, at: pa.Array) -> pa.Array:
        value = shared.value
        if "cascades" not in value:
            value["cascades"] = Cascades(value["rows"], value["shards"])
        flat = h.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        shard = (at.flatten().to_numpy(zero_copy_only=False) % value["shards"]).astype(np.int64)
        sizes = np.fromiter((len(x) if x.is_valid else 0 for x in h), np.int64, len(h))
        seen = np.concatenate([[0], np.cumsum(value["cascades"].contains(flat, shard))])
        ends = np.cumsum(sizes)
        return pa.array(seen[ends] > seen[ends - sizes])

    return judge


def _any_listed(df: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """``df`` and the boolean ``__listed``: any of ``__keys`` is in the list.
    Each pass sends the tasks a bounded part of the shards' filters, and its
    result is written before the next, so only one part is held at a time."""
    sizes = table.groupBy("shard").agg(F.sum(F.length("filter")).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    passes = max(1, math.ceil(total / PASS_BYTES * 1.1))
    out, spark = df.withColumn("__listed", F.lit(False)), df.sparkSession
    for p in range(passes):
        rows = [tuple(r) for r in table.where(F.col("shard") % passes == p).orderBy("shard", "level").collect()]
        shared = spark.sparkContext.broadcast({"rows": rows, "shards": shards})

        test = F.arrow_udf(_judge(shared), "boolean")
        out = out.withColumn("__listed", F.col("__listed") | test(
            F.transform("__keys", lambda k: F.xxhash64(k)), F.transform("__keys", lambda k: F.xxhash64(k, F.lit(1)))))
        if p < passes - 1:
            out = materialize(out, "url-pass")
            shared.unpersist()
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = (), url_col: str = "url",
               out_col: str = "judged") -> DataFrame:
    """``pages`` and the struct ``out_col``: ``host``, ``path``, ``rule`` (the
    longest rule that fits, or null), ``listed`` (a key of the URL is in
    ``listed``, one column ``key`` of hosts, domains, or host with path) and
    ``verdict``: the rule's, else ``block`` for a listed URL, else ``allow``.

    A null URL, or one without ``://``, has empty host and path and no keys.
    Repeated and empty rows are judged alike; nulls in ``listed`` are ignored;
    other columns pass through."""
    host, path = split_url(F.col(url_col))
    d = pages.withColumns({"__host": host, "__path": path})
    d = d.withColumn("__keys", keys_of(F.col("__host"), F.col("__path")))
    table, shards = cascade_table(d.select(F.explode("__keys").alias("key")), listed)
    d = _any_listed(d, table, shards).withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), list(rules)))
    verdict = F.when(F.col("__listed"), "block").otherwise("allow")
    for pattern, what in rules:
        verdict = F.when(F.col("__rule") == pattern, what).otherwise(verdict)
    return d.select(*pages.columns, F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
        F.col("__listed").alias("listed"), verdict.alias("verdict")).alias(out_col))
