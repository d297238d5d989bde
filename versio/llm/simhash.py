"""SimHash near-duplicate groups by deletion-variant signatures.

Two 64-bit fingerprints within ``max_bits`` are cut into ``max_bits // 2 + 1``
segments, so at least one segment differs by at most one bit. Every segment is
indexed as it is and once for each of its bits with that bit replaced by a
wildcard; fingerprints that share an entry are joined on it and verified on all
64 bits. Exact copies have one fingerprint and are one node throughout.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, connected_components, materialize, not_broadcast, scratch_tables

BITS = 64
#: Fingerprints with one segment value beyond which its index entries get
#: further entries from the remaining bits (the links found are the same).
BUCKET = 128


def text_fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text (UTF-8). A-Z are lower-cased; words
    end at ASCII white space; a text of fewer words than a shingle is one
    shingle; one without words, or null, has fingerprint zero."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total, ones = 0, np.zeros(BITS, np.int64)
    for a in range(0, len(words) - shingle + 1, 1 << 15):  # blocks: bounded memory for any length
        part = words[a:a + (1 << 15) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        total += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """One row ``doc_id, fp`` (the fingerprint as a signed long) per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((text_fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _entries(df: DataFrame, bits: list[int], left: bool, once: bool = False) -> DataFrame:
    """Index entries of the segment made of ``bits``: its value, and for each
    bit the value with that bit as a wildcard. Fingerprints that meet at a
    wildcard entry shall differ in that bit (equal values meet at the exact
    entry), so the entry also names the bit on the left and its complement on
    the right. ``once`` keeps only zero bits on the left and one bits on the
    right, so a pair meets in one order."""
    wild = F.array(*[F.lit(_signed(1 << b)) for b in bits], F.lit(0).cast("long"))
    mask = F.lit(_signed(sum(1 << b for b in bits)))

    def entry(w):
        bit = F.col("fp").bitwiseAND(w) != 0
        side = F.when(w == 0, F.lit(2)).otherwise((bit if left else ~bit).cast("int"))
        value = F.col("fp").bitwiseAND(mask).bitwiseAND(F.bitwise_not(w))
        return F.struct(side.alias("side"), F.xxhash64(F.col("key"), mask, w, value, side).alias("key"))

    out = df.select("fp", F.explode(F.transform(wild, entry)).alias("e"))
    return (out.where("e.side != 1") if once else out).select("fp", "e.key")


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _verified(left: DataFrame, right: DataFrame, max_bits: int) -> DataFrame:
    l, r = left.select("key", F.col("fp").alias("a")), right.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return (l.join(not_broadcast(r), (l["key"] == r["key"]) & (F.col("a") != F.col("b")) & near)
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _links(left: DataFrame, right: DataFrame, rest: list[int], max_bits: int, bucket: int) -> list[DataFrame]:
    """Links among rows that share ``key``. Keys with more than ``bucket``
    rows on a side are indexed once more by segments of the bits in ``rest``,
    which hold at most ``max_bits`` differences, and so on until so few bits
    are free that even a full key is small. No pair is lost at any level."""
    if len(rest) <= 8:
        return [_verified(left, right, max_bits)]
    full = materialize(left.groupBy("key").count().where(F.col("count") > bucket).select("key")
                       .union(right.groupBy("key").count().where(F.col("count") > bucket).select("key"))
                       .distinct(), "simhash-full")
    if full.isEmpty():
        return [_verified(left, right, max_bits)]
    full = checked_broadcast(full)
    out = [_verified(left.join(full, "key", "left_anti"), right.join(full, "key", "left_anti"), max_bits)]
    left = materialize(left.join(full, "key", "left_semi"), "simhash-left")
    right = materialize(right.join(full, "key", "left_semi"), "simhash-right")
    for part in _cut(rest, max_bits // 2 + 1):
        out += _links(_entries(left, part, True), _entries(right, part, False),
                      [b for b in rest if b not in part], max_bits, bucket)
    return out


def near_links(nodes: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """All links ``u, v`` (u > v) between the distinct ``fp`` of ``nodes`` that
    differ in at most ``max_bits`` bits."""
    nodes = nodes.select("fp", F.lit(0).cast("long").alias("key"))
    every, out = list(range(BITS)), []
    for part in _cut(every, max_bits // 2 + 1):
        mask = F.lit(_signed(sum(1 << b for b in part)))
        rest = [b for b in every if b not in part]
        left, right = _entries(nodes, part, True, True), _entries(nodes, part, False, True)
        # entries can only be full where a segment value is: a cheap look first
        crowded = (nodes.groupBy(F.col("fp").bitwiseAND(mask)).count()
                   .where(F.col("count") > bucket).limit(1).count())
        out += _links(left, right, rest, max_bits, bucket) if crowded else [_verified(left, right, max_bits)]
    links = out[0]
    for x in out[1:]:
        links = links.unionByName(x)
    return links.distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row ``doc_id, fingerprint, component_id`` per row of ``docs``.

    The component id is the smallest id reachable over links of at most
    ``max_bits`` bits, the document itself included (rows without an id have
    the component of their group, or null if no member has one). Null and empty
    texts have fingerprint zero and are linked like any other; repeated rows
    come back as often as they came; an empty table gives an empty result."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(near_links(nodes, max_bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = materialize(named.join(least, "root").select("fp", "component_id"), "simhash-label")
    return fps.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id
    (of rows with that id, the one with the smallest hash of id and text).
    Documents are told apart by id and text, so an id that comes with different
    texts is a document of each text's group, and repeated rows come back once.
    Rows without an id are kept."""
    with scratch_tables(docs.sparkSession):
        named = docs.where(F.col(id_col).isNotNull())
        row = F.xxhash64(id_col, text_col)
        keyed = named.select(F.struct(F.col(id_col).alias("id"), row.alias("row")).alias("at"), F.col(text_col).alias("text"))
        groups = simhash_groups(keyed, "at", "text", shingle, max_bits, seed)
        # a group is known by its smallest (id, row): the document that stays
        gone = materialize(groups.where("doc_id != component_id").select(
            F.col("doc_id.id").alias("__id"), F.col("doc_id.row").alias("__row")).distinct(), "simhash-gone", keep=True)
        again = materialize(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(
            F.col("doc_id.id").alias("__id"), F.col("doc_id.row").alias("__row")), "simhash-again", keep=True)
    here = (F.col(id_col) == F.col("__id")) & (F.xxhash64(id_col, text_col) == F.col("__row"))
    kept = docs.join(checked_broadcast(gone), here, "left_anti")
    if again.isEmpty():
        return kept
    copies = kept.join(checked_broadcast(again), here, "left_semi")
    return kept.join(checked_broadcast(again), here, "left_anti").unionByName(copies.dropDuplicates([id_col, text_col]))
