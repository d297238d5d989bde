"""Benchmark decontamination by winnowing, in DataFrame operations only.

A span of ``span`` words shared with a benchmark item shall never be missed.
Words are hashed, runs of ``k`` words give grams, and in every window of
``span - k + 1`` grams the smallest (leftmost of equals) is kept as a
fingerprint, together with its position. The choice depends on nothing but the
window's words, so a span that occurs in a document and in an item has the same
fingerprint in both. Fingerprints are joined, and every hit is extended word by
word on both sides; it counts if the run reaches the whole span. Items of fewer
words than ``span`` are one window: they take part with their own length.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, with_row

SPAN = 13
GRAM = 5
#: Positions take the low bits of a packed gram, its hash the others.
_POS_BITS = 30
_POS = (1 << _POS_BITS) - 1
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text) -> Column:
    """The words of a text: A-Z in lower case, runs of characters other than
    ASCII punctuation, symbols, white space and controls. Null has none."""
    t = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(t) == F.char_length(t)  # ASCII only: lower() is the same and faster
    low = F.when(plain, F.lower(t)).otherwise(
        F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _SEPARATOR), "")


def fingerprints_of(words: Column, span: int, gram: int) -> Column:
    """Array of ``(span, pos, hash)``: the winnowed grams of one word array."""
    k = min(gram, span)
    window = span - k + 1

    def grams(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def packed(g):
        return F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long")))

    def chosen(p):
        least = F.transform(F.sequence(F.lit(1), F.size(p) - window + 1), lambda i: F.array_min(F.slice(p, i, window)))
        return F.transform(F.array_distinct(least), lambda x: x.bitwiseAND(F.lit(_POS)).cast("int"))

    def marks(g):
        return F.transform(_let(packed(g), chosen), lambda pos: F.struct(
            F.lit(span).alias("span"), pos.alias("pos"), F.get(g, pos).alias("hash")))

    def of(w):
        return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(grams(h), marks))

    none = F.array().cast("array<struct<span:int,pos:int,hash:bigint>>")
    return _let(words, lambda w: F.when(F.size(w) >= span, of(w)).otherwise(none))


def benchmark_items(benchmark: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """``item (array of ids), words, span`` of each distinct word sequence."""
    w = benchmark.select(F.col(id_col).alias("item_id"), words_of(text_col).alias("words")).where("size(words) > 0")
    w = w.groupBy(F.concat_ws(" ", "words").alias("joined")).agg(F.collect_set("item_id").alias("items"))
    w = w.withColumn("words", F.split("joined", " "))
    return w.select(F.xxhash64("joined").alias("seq"), "items", "words", F.least(F.size("words"), F.lit(span)).alias("span"))


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
         text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, row, n_words, n_hit, items`` of each document with a hit: its words
    inside any occurrence of an item window, and the ids of those items.
    ``row`` is the hash of id and text, see ``common.with_row``."""
    items = materialize(benchmark_items(benchmark, span, item_id, item_text), "decon-items")
    spans = [r["span"] for r in items.select("span").distinct().orderBy("span").collect()]  # at most ``span`` numbers
    empty = with_row(docs, id_col, text_col).where("false").select(
        "id", "row", F.lit(0).alias("n_words"), F.lit(0).alias("n_hit"),
        F.array().cast(f"array<{benchmark.schema[item_id].dataType.simpleString()}>").alias("items"))
    if not spans:
        return empty
    marks = None
    for s in spans:
        m = items.where(F.col("span") == s).select("seq", F.explode(fingerprints_of(F.col("words"), s, gram)).alias("f"))
        marks = m if marks is None else marks.unionByName(m)
    marks = materialize(marks.select("seq", "f.span", F.col("f.pos").alias("ipos"), "f.hash"), "decon-marks")

    d = with_row(docs, id_col, text_col)
    found = F.concat(*[fingerprints_of(F.col("words"), s, gram) for s in spans]) if len(spans) > 1 else \
        fingerprints_of(F.col("words"), spans[0], gram)
    prints = (d.select("id", "row", words_of("text").alias("words")).select("id", "row", F.explode(found).alias("f"))
              .select("id", "row", "f.span", "f.pos", "f.hash"))
    met = materialize(prints.join(checked_broadcast(marks), ["span", "hash"])
                      .select("id", "row", "span", "pos", "seq", "ipos").distinct(), "decon-met")

    keys = checked_broadcast(materialize(met.select(F.col("id").alias("k_id"), F.col("row").alias("k_row")).distinct(), "decon-docs"))
    texts = (d.join(keys, d["id"].eqNullSafe(keys["k_id"]) & (d["row"] == keys["k_row"]))
             .select(F.col("k_id"), F.col("k_row"), words_of("text").alias("d_words")).dropDuplicates(["k_id", "k_row"]))
    seqs = checked_broadcast(items.select("seq", F.col("words").alias("i_words")), 20_000)
    by_doc = met.groupBy("id", "row").agg(F.collect_list(F.struct("span", "pos", "seq", "ipos")).alias("at"))
    joined = by_doc.join(texts, by_doc["id"].eqNullSafe(texts["k_id"]) & (by_doc["row"] == texts["k_row"]))

    # in each document, hits become its word windows around them; items are joined on these
    def around(h):
        reach = h["span"] - F.least(h["span"], F.lit(gram))
        return F.struct(h["span"].alias("span"), h["pos"].alias("pos"), h["seq"].alias("seq"), h["ipos"].alias("ipos"),
                        F.greatest(h["pos"] - reach, F.lit(0)).alias("from"),
                        F.slice("d_words", F.greatest(h["pos"] - reach, F.lit(0)) + 1,
                                reach * 2 + F.least(h["span"], F.lit(gram))).alias("near"))

    near = (joined.select("id", "row", F.size("d_words").alias("n_words"), F.explode(F.transform("at", around)).alias("h"))
            .select("id", "row", "n_words", "h.*").join(seqs, "seq"))
    here, k = F.col("pos") - F.col("from"), F.least(F.col("span"), F.lit(gram))

    def equal(j):
        return F.coalesce(F.get("near", here + j) == F.get("i_words", F.col("ipos") + j), F.lit(False))

    def run(first, step, most):
        """How many words in a row are equal, from offset ``first`` on."""
        offs = F.sequence(F.lit(0), most)  # one past the reach: stands for the end
        stop = F.filter(offs, lambda n: (n >= most) | ~equal(first + n * step))
        return F.array_min(stop)

    right, left = run(F.lit(0), 1, F.col("span")), run(F.lit(-1), -1, F.col("span") - k)
    runs = near.select("id", "row", "n_words", "seq", "span", "pos", k.alias("k"), left.alias("left"), right.alias("right"))
    runs = runs.where((F.col("right") >= F.col("k")) & (F.col("left") + F.col("right") >= F.col("span")))
    runs = runs.join(checked_broadcast(items.select("seq", "items"), 20_000), "seq")
    return runs.groupBy("id", "row", "n_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos") - F.col("left"),
                                                                   F.col("pos") + F.col("right") - 1))))).alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  one_in: int = 20) -> DataFrame:
    """``docs`` with the struct ``contamination``: ``n_words``, ``n_hit``,
    ``items`` (ids with an occurring window) and ``contaminated``, which is
    ``n_hit > 0 and one_in * n_hit >= n_words``.

    Null and empty texts have no words and no hits; items without words or a
    benchmark without rows hit nothing; a repeated item id counts once and an
    item without an id only by its words. Repeated rows come back alike."""
    found = materialize(hits(docs, benchmark, span, gram, id_col, text_col, item_id, item_text), "decon-hits")
    found = checked_broadcast(found.select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("n_hit").alias("__n"),
                                           F.col("items").alias("__items")), 200_000)
    d = docs.withColumn("__at", F.xxhash64(id_col, text_col))
    d = d.join(found, d[id_col].eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__row")), "left")
    n_words, n_hit = F.size(words_of(text_col)), F.coalesce("__n", F.lit(0))
    items = F.coalesce("__items", F.array().cast(found.schema["__items"].dataType))
    return d.select(*docs.columns, F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"))
                    .alias("c")).select(*docs.columns, F.struct(
                        "c.n_words", "c.n_hit", "c.items",
                        ((F.col("c.n_hit") > 0) & (one_in * F.col("c.n_hit") >= F.col("c.n_words"))).alias("contaminated"))
        .alias("contamination"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
               text_col: str = "text", item_id: str = "item_id", item_text: str = "text", one_in: int = 20) -> DataFrame:
    """The filtering stage: the rows of ``docs`` that are not contaminated."""
    found = hits(docs, benchmark, span, gram, id_col, text_col, item_id, item_text)
    bad = materialize(found.where(one_in * F.col("n_hit") >= F.col("n_words")).select("id", "row"), "decon-bad")
    bad = checked_broadcast(bad.select(F.col("id").alias("__id"), F.col("row").alias("__row")))
    d = docs.withColumn("__at", F.xxhash64(id_col, text_col))
    return d.join(bad, d[id_col].eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__row")), "left_anti").select(*docs.columns)
