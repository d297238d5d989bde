"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic models. Each later
model sees, besides the text's features, the probabilities of the categories
before it; in training these come from models that did not see the row
(out-of-fold), so that they are as uncertain as they will be on new texts.

Features are the character n-grams (with word ends) that go most clearly with a
category among the labelled texts: the logarithm of their count in the whole text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

GRAM, BUCKETS = 5, 1 << 20
#: Labelled documents that the chain is fitted on, at most; n-grams kept per category.
MAX_LABELS, PER_CATEGORY = 10_000, 256
FOLDS = 3
CHARS = 1 << 18


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a whole text, a block at a time: lower case,
    every run of characters that are no letters is one space."""
    for a in range(0, len(text), CHARS):
        part = " " + text[max(0, a - 4 * GRAM):a + CHARS].lower() + " "
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        letter = (c - 97 < 26) | (c >= 0xAA) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c < 0x2C00))
        c = np.where(letter, c, np.uint32(32))[letter | np.concatenate([[True], letter[:-1]])].astype(np.uint32)
        if len(c) < GRAM:
            continue
        h = np.zeros(len(c) - GRAM + 1, np.uint32)
        for i in range(GRAM):
            h = h * np.uint32(0x01000193) + c[i:len(c) - GRAM + 1 + i]
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x9E3779B1)) >> np.uint32(12)


def gram_counts(text: str, column: np.ndarray, width: int) -> np.ndarray:
    """How often the chosen n-grams (``column``: bucket to feature, or -1) occur."""
    out = np.zeros(width, np.int64)
    for h in grams(text):
        at = column[h]
        out += np.bincount(at[at >= 0], minlength=width)
    return out.astype(np.int32)


def bucket_counts(rows: DataFrame, categories: list[str]) -> DataFrame:
    """``bucket, n, n_<category> ...``: in how many texts a bucket occurs, and in
    how many of each category."""
    names = ["bucket", "n", *[f"n_{i}" for i in range(len(categories))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(categories) + 1, BUCKETS), np.int32)
        for b in batches:
            marks = [b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(categories))]
            for r, t in enumerate(b.column(0)):
                seen = np.zeros(BUCKETS, bool)
                for h in grams(t.as_py()):
                    seen[h] = True
                at = np.flatnonzero(seen)
                n[0, at] += 1
                for i, m in enumerate(marks):
                    if m[r]:
                        n[1 + i, at] += 1
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at].astype(np.int64)) for x in n]], names)

    counts = rows.select("text", *categories).mapInArrow(run, "bucket long, " + ", ".join(f"{x} long" for x in names[1:]))
    return counts.groupBy("bucket").agg(*[F.sum(x).alias(x) for x in names[1:]])


def choose_grams(counts: DataFrame, totals: list[int], n: int, per_category: int) -> list[int]:
    """For each category the buckets that go with it most (chi-square, only
    where it raises the category's share)."""
    out: set[int] = set()
    for i, total in enumerate(totals):
        if not 0 < total < n:
            continue
        a, b = F.col(f"n_{i}"), F.col("n") - F.col(f"n_{i}")
        c, d = F.lit(total) - a, F.lit(n - total) - b
        chi = F.pow((a * d - b * c).cast("double"), 2) / ((a + b) * (c + d) * F.lit(float(total)) * (n - total) + 1.0)
        top = (counts.where(a * (n - total) > b * total).select("bucket", chi.alias("chi"))
               .orderBy(F.desc("chi"), "bucket").limit(per_category).collect())
        out |= {r["bucket"] for r in top}
    return sorted(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-5, steps: int = 500) -> np.ndarray:
    """Weights (the intercept last) by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # largest curvature, by power iteration
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * 1.05 * float(np.linalg.norm(x @ v)) ** 2 / len(x) + penalty)
    w = look = np.zeros(x.shape[1], x.dtype)
    shrink = np.full(x.shape[1], penalty, x.dtype)
    shrink[-1] = 0
    for i in range(steps):
        p = 1 / (1 + np.exp(-(x @ look)))
        new = look - rate * (x.T @ (p - y) / len(x) + shrink * look)
        look, w = new + i / (i + 3) * (new - w), new
    return w.astype(np.float64)


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One model per column of ``labels``, in order. Model j sees the features
    and the out-of-fold probabilities of the categories before it. A category
    with one class only gets a constant."""
    models, earlier = [], np.zeros((len(x), 0), np.float32)
    for j in range(labels.shape[1]):
        y, seen = labels[:, j].astype(np.float32), np.hstack([x, earlier])
        if y.min() == y.max():
            w = np.zeros(seen.shape[1] + 1)
            w[-1] = 40.0 if y[0] else -40.0
            models.append(w)
            held = np.full(len(x), y[0])
        else:
            models.append(fit_logistic(seen, y))
            held = np.zeros(len(x), np.float32)
            for f in np.unique(fold):
                rest = fold != f
                if not rest.any() or y[rest].min() == y[rest].max():
                    held[~rest] = y[rest].mean() if rest.any() else y.mean()
                else:
                    held[~rest] = probability(seen[~rest], fit_logistic(seen[rest], y[rest]))
        earlier = np.hstack([earlier, held[:, None].astype(np.float32)])
    return models


def run_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """Probabilities, one column per category."""
    p = np.zeros((len(x), 0))
    for w in models:
        p = np.hstack([p, probability(np.hstack([x, p]), w)[:, None]])
    return p


def train(labelled: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
          max_labels: int = MAX_LABELS, per_category: int = PER_CATEGORY, folds: int = FOLDS) -> dict | None:
    """Fit the chain on at most ``max_labels`` rows of ``labelled`` (id, text and
    one 0/1 column per category; those with the smallest hash of their id). A
    null label counts as 0. ``None`` if there is no row with a text and an id."""
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(id_col).alias("at"), F.col(text_col).alias("text"),
        *[(F.coalesce(F.col(c).cast("int"), F.lit(0)) > 0).alias(c) for c in categories])
    bar = rows.select("at").orderBy("at").limit(max_labels).agg(F.max("at")).first()[0]
    if bar is None:
        return None
    rows = rows.where(F.col("at") <= bar).dropDuplicates(["at"])  # max_labels rows: one for each id
    rows = materialize(rows.repartition(8, "at"), "toxic-labels")
    n, *totals = rows.agg(F.count("*"), *[F.sum(F.col(c).cast("int")) for c in categories]).first()
    chosen = choose_grams(materialize(bucket_counts(rows, categories), "toxic-grams"), totals, n, per_category)
    column = np.full(BUCKETS, -1, np.int16)
    column[chosen] = np.arange(len(chosen))
    width = len(chosen)

    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([gram_counts(t.as_py(), column, width).tobytes() for t in texts], pa.binary())

    got = rows.select("at", F.arrow_udf(packed, "binary")("text").alias("x"), *categories).orderBy("at").collect()  # max_labels rows
    x = np.log1p(np.frombuffer(b"".join(r["x"] for r in got), np.int32).reshape(len(got), width).astype(np.float32))
    labels = np.array([[r[c] for c in categories] for r in got])
    fold = np.array([r["at"] for r in got]) % folds
    return {"chosen": chosen, "models": fit_chain(x, labels, fold), "categories": list(categories)}


def score(docs: DataFrame, model: dict | None, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` and the struct ``out_col`` with the probability of each category.

    A null or empty text has probability 0 of everything; without a model all
    texts have. Repeated rows get the same result; other columns pass through."""
    if model is None:
        raise ValueError("the chain has not been fitted: there were no labelled texts")
    names = model["categories"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred n-grams and weights
    kind = "struct<" + ",".join(f"`{c}`:double" for c in names) + ">"

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        width = len(m["chosen"])
        column = np.full(BUCKETS, -1, np.int16)
        column[m["chosen"]] = np.arange(width)
        rows = texts.to_pylist()
        x = np.stack([gram_counts(t or "", column, width) for t in rows]) if rows else np.zeros((0, width))
        p = run_chain(np.log1p(x.astype(np.float64)), m["models"])
        p[[not t for t in rows]] = 0.0
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(names))], names)

    return docs.withColumn(out_col, F.arrow_udf(run, kind)(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
             out_col: str = "toxicity", **settings) -> DataFrame:
    """Fit on the documents that ``labels`` (id and one 0/1 column per category)
    covers and score all ``docs``. Several labels of one id count as their
    largest. Without any usable label all probabilities are 0."""
    ids = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        *[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"__{c}") for c in categories])
    most = settings.get("max_labels", MAX_LABELS)
    ids = materialize(ids.orderBy(F.xxhash64(id_col), id_col).limit(most), "toxic-ids")
    known = docs.select(id_col, text_col).join(checked_broadcast(ids), id_col).select(
        id_col, text_col, *[F.col(f"__{c}").alias(c) for c in categories])
    model = train(known, categories, id_col, text_col, **settings)
    if model is None:
        return docs.withColumn(out_col, F.struct(*[F.lit(0.0).alias(c) for c in categories]))
    return score(docs, model, text_col, out_col)
