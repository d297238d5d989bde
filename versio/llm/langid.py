"""Language identification by nearest centroids.

A text becomes a TF-IDF vector of its character n-grams (hashed to a fixed
number of buckets), normalised to length one. Each language has several
centroids, found by spherical k-means on a bounded sample of its labelled
texts. The language of the nearest centroid by cosine wins; a text whose
cosine to it lies below nearly all training texts of that centroid is marked as
rejected (its distance is too large to be trusted).
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

SIZES = (1, 2, 3)
DIMS = 4096
#: Labelled texts per language that the centroids are fitted on, at most.
MAX_SAMPLE = 2000
CENTROIDS = 4
#: Characters that are counted at a time (memory per text stays bounded).
CHARS = 1 << 18
_MULT = np.uint32(0x9E3779B1)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text: lower case, every run of
    characters that are no letters is one space."""
    out = np.zeros(DIMS, np.int64)
    for a in range(0, len(text), CHARS):  # blocks overlap by what the longest n-gram needs
        part = text[max(0, a - max(SIZES) + 1):a + CHARS].lower()
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        letter = (c - 97 < 26) | (c >= 0xAA) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c < 0x2C00))
        keep = letter | np.concatenate([[True], letter[:-1]])
        c = np.where(letter, c, np.uint32(32))[keep]
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(SIZES) + 1):
            if n > len(c):
                break
            h = (h[:len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1:] + np.uint32(n)) * _MULT
            if n in SIZES:
                out += np.bincount((h * _MULT) >> np.uint32(20), minlength=DIMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors, one row per text's counts."""
    return _unit(np.log1p(np.stack(counts).astype(np.float32)) * idf)


def has_letter(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"\p{L}")


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts (one column ``text``) each bucket occurs, and
    their number: every task counts its texts, the sums are grouped by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                df += ngram_counts(t.as_py()) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["b", "n"])

    out, n = np.zeros(DIMS), 0
    for b, c in texts.mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n")).collect():  # DIMS + 1 rows at most
        if b < 0:
            n = c
        else:
            out[b] = c
    return out, n


def fit_centroids(lang: str, x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> pd.DataFrame:
    """Up to ``k`` centroids of one language's unit vectors by spherical
    k-means, each with the cosine under which a hundredth of its own texts lie."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    near, cos = (x @ c.T).argmax(axis=1), (x @ c.T).max(axis=1)
    used = [i for i in range(len(c)) if (near == i).any()]
    return pd.DataFrame({"lang": [lang] * len(used), "centroid": [c[i].astype("<f4").tobytes() for i in used],
                         "least": [float(np.quantile(cos[near == i], 0.01)) for i in used]})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_sample: int = MAX_SAMPLE,
          centroids: int = CENTROIDS) -> dict | None:
    """Learn from the rows of ``docs`` with a language and a letter in the text.
    IDF counts all of them; the centroids use at most ``max_sample`` texts per
    language, those with the smallest hash. ``None`` if there is nothing to learn."""
    known = docs.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df, n = document_frequencies(known.select("text"))
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # the hash below which about max_sample distinct texts of a language lie keeps
    # all but a bounded number of them out of the grouping; the exact cut follows
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    sizes = materialize(known.select("lang", place.alias("at")).distinct().groupBy("lang").count(), "lang-sizes")
    sizes = sizes.withColumn("bar", F.least(F.lit(1.0), (max_sample + 6 * max_sample ** 0.5) / F.col("count")))
    some = known.join(checked_broadcast(sizes), "lang").withColumn("at", place).where("at <= bar")
    # copies of one text have one hash: count it once, so the sample stays bounded
    # and only counts are grouped, so long texts take no more room than short ones
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([ngram_counts(t.as_py()).astype("<i4").tobytes() for t in texts], pa.binary())

    some = some.select("lang", "at", F.arrow_udf(counted, "binary")("text").alias("counts")).dropDuplicates(["lang", "at"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("at")["counts"].head(max_sample)
        return fit_centroids(key[0], vectors([np.frombuffer(c, "<i4") for c in rows], idf), centroids)

    rows = some.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, least double").collect()  # a few per language
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    return {"idf": idf, "langs": [r["lang"] for r in rows], "least": np.array([r["least"] for r in rows]),
            "centroids": np.stack([np.frombuffer(r["centroid"], "<f4") for r in rows])}


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", out_col: str = "language",
            undetermined: str = "und") -> DataFrame:
    """``docs`` and the struct ``out_col``: ``lang`` of the nearest centroid,
    ``score`` (its cosine, 0 to 1) and ``rejected`` (too far from the centroid).

    A null text, or one without a letter, is ``und`` with score 0 and rejected;
    so is every text if there was nothing to learn. Repeated rows get the same
    result, empty tables none; other columns pass through. Very long texts are
    counted whole, a block at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x DIMS numbers
    kind = "struct<lang:string,score:double,rejected:boolean>"

    def run(texts: pa.Array) -> pa.Array:
        m, lang, score, far = shared.value, [], [], []
        rows = texts.to_pylist()
        for a in range(0, len(rows), 256):
            cos = vectors([ngram_counts(t) for t in rows[a:a + 256]], m["idf"]) @ m["centroids"].T
            best = cos.argmax(axis=1)
            top = cos[np.arange(len(best)), best].astype(float)
            lang += [m["langs"][i] for i in best]
            score += np.clip(top, 0, 1).tolist()
            far += (top < m["least"][best] - 1e-4).tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())],
                                          ["lang", "score", "rejected"])

    none = F.struct(F.lit(undetermined).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return docs.withColumn(out_col, none)
    usable = has_letter(F.col(text_col))
    got = F.arrow_udf(run, kind)(F.when(usable, F.col(text_col)).otherwise(F.lit("")))
    return docs.withColumn(out_col, F.when(usable, got).otherwise(none))
