"""Quality classifier with hierarchical empirical Bayes.

A linear classifier on surface features of the whole text gives each document
its evidence. Hosts and the paths below them get posteriors by grouped
aggregation of that evidence over all documents: a path is shrunk towards its
host, a host towards the corpus, and sparse sites most. The document's
posterior joins both: evidence odds times its path's prior odds.
"""

import math
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, materialize

FEATURES = ["upper", "digit", "punctuation", "symbol", "exclaim", "space", "non_ascii", "word_length",
            "repeat_next", "top_word", "window_distinct", "line_repeat", "sentence_end", "bare_word"]
WINDOW = 50
#: Posterior odds are kept within this many log-odds.
LOGIT_CAP = 30.0
_SYMBOLS = np.frombuffer(b"#$%&*|~^<>{}[]\\=+_@", np.uint8)
_BARE = frozenset(b"#$%&*|~^<>{}[]\\=+_@!?.,;:-/()'\"0123456789")


def text_features(text: str | None) -> list[float] | None:
    """``FEATURES`` of a whole text, all between 0 and about 1; ``None`` for a
    null text or one without a word."""
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.split()
    if not words:
        return None
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    counts: dict[bytes, int] = {}
    distinct = 0
    for a in range(0, n, WINDOW):
        distinct += len(set(words[a:a + WINDOW]))
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    ends = sum(c for w, c in counts.items() if w[-1] in b".!?")
    bare = sum(c for w, c in counts.items() if _BARE.issuperset(w))
    return [
        upper / max(1, upper + lower), int(h[48:58].sum()) / size,
        int(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / size,
        int(h[_SYMBOLS].sum()) / size, int(h[33]) / size, int(h[32] + h[10]) / size, int(h[128:].sum()) / size,
        min(1.0, (size - int(h[32] + h[10])) / n / 40),
        sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, distinct / n,
        1 - len(set(lines)) / max(1, len(lines)), ends / n, bare / n,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_udf(text: pd.Series) -> pd.Series:
    return text.map(text_features, na_action="ignore")


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> dict | None:
    """Fit the document classifier on at most ``max_labels`` labelled documents
    (those with the smallest hash of their id). Several labels of one document
    count as their smallest. Returns weights, intercept and the label mean, or
    ``None`` if one of the classes is missing: there is no evidence then."""
    one = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(id_col).agg(F.min(label_col).cast("double").alias("__label")))
    one = materialize(one.orderBy(F.xxhash64(id_col), id_col).limit(max_labels), "quality-labels")
    # written before the features are made: a filter on them would be pushed below the join
    known = docs.join(checked_broadcast(one), id_col).select(F.col(text_col).alias("text"), F.col("__label").alias("label"))
    known = materialize(known.where("text is not null").repartition(12), "quality-known")
    rows = materialize(known.select(features_udf("text").alias("f"), "label"), "quality-train")
    rows = rows.where("f is not null").select(array_to_vector("f").alias("features"), "label")
    stats = rows.agg(F.avg("label").alias("mean"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if stats["lo"] is None or stats["lo"] == stats["hi"]:
        return None
    fit = LogisticRegression(maxIter=60, regParam=1e-4, standardization=True).fit(rows)
    return {"weights": [float(x) for x in fit.coefficients], "intercept": float(fit.intercept), "mean": stats["mean"]}


def evidence(text_col: str, model: dict | None):
    """Column: log-odds the text alone adds to the prior; 0 without a word. Spark
    is told that it is not deterministic: a filter that needs it, or that it is not
    null, would be pushed below it with a second evaluation of every text, by a
    second Python worker in each task."""
    if model is None:
        return F.lit(0.0)
    w, base, cap = np.array(model["weights"]), model["intercept"] - _logit(model["mean"]), LOGIT_CAP

    def score(text: pd.Series) -> pd.Series:
        f = [text_features(t) for t in text]
        return pd.Series([0.0 if x is None else float(np.clip(np.dot(w, x) + base, -cap, cap)) for x in f])

    return F.pandas_udf(score, T.DoubleType()).asNondeterministic()(F.col(text_col))


def _strength(n_sites, spread, noise, mean) -> float:
    """Prior strength in documents, by moments: the spread of the group means
    beyond what their sizes explain."""
    tau = (spread or 0.0) - (noise or 0.0)
    if not n_sites or n_sites < 2 or tau <= 1e-9:
        return 1e4
    return min(1e4, max(1.0, mean * (1 - mean) / tau - 1))


def site_posteriors(scored: DataFrame, prior: float) -> tuple[DataFrame, float]:
    """From ``host, path, evidence`` of all documents: one row ``host, path,
    host_n, path_n, host_p, path_p`` per path, and the corpus mean."""
    base = _logit(prior)
    p = _sigmoid(F.col("evidence") + F.lit(base))
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum(p).alias("path_s")), "quality-path")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    hosts = materialize(hosts, "quality-host")
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else prior
    var = mean * (1 - mean)
    m = hosts.agg(F.count("*").alias("k"), F.avg(F.pow(F.col("host_s") / F.col("host_n") - mean, 2)).alias("spread"),
                  F.avg(var / F.col("host_n")).alias("noise")).first()
    k1 = _strength(m["k"], m["spread"], m["noise"], mean)
    hosts = hosts.withColumn("host_p", (F.col("host_s") + k1 * mean) / (F.col("host_n") + k1))
    both = materialize(paths.join(hosts, "host"), "quality-site")
    own = F.col("host_p") * (1 - F.col("host_p"))
    m = both.agg(F.count("*").alias("k"), F.avg(F.pow(F.col("path_s") / F.col("path_n") - F.col("host_p"), 2)).alias("spread"),
                 F.avg(own / F.col("path_n")).alias("noise")).first()
    k2 = _strength(m["k"], m["spread"], m["noise"], mean)
    both = both.withColumn("path_p", (F.col("path_s") + k2 * F.col("host_p")) / (F.col("path_n") + k2))
    return both.select("host", "path", "host_n", "path_n", "host_p", "path_p"), mean


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    host_col: str = "source", path_col: str = "lang", max_labels: int = 20_000,
                    threshold: float = 0.5) -> DataFrame:
    """``docs`` and the struct ``quality_score``: ``evidence`` (log-odds from
    the text), ``host_p``, ``path_p`` (shrunken site posteriors), ``p_quality``
    and ``keep`` (``p_quality >= threshold``).

    Null hosts and paths are sites of their own. A null text or one without a
    word has no evidence: its site alone decides. Without labels of both classes
    there is no evidence and the prior is 1, so every row is kept. Repeated rows
    each get their score. Extra columns, also of these names, pass through."""
    model = train(docs, labels, max_labels, id_col, text_col)
    prior = model["mean"] if model else 1.0
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\x00"))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("\x00"))
    scored = docs.select(host.alias("host"), path.alias("path"), evidence(text_col, model).alias("evidence"))
    sites, _ = site_posteriors(scored, prior)
    sites = checked_broadcast(materialize(sites, "quality-sites")).select(
        F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("host_p").alias("__hp"), F.col("path_p").alias("__pp"))
    d = docs.withColumns({"__h": host, "__p": path, "__e": evidence(text_col, model)})
    d = d.join(sites, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__path")))
    odds = F.ln(F.greatest(F.col("__pp"), F.lit(1e-9)) / F.greatest(1 - F.col("__pp"), F.lit(1e-9)))
    post = _sigmoid(F.col("__e") + odds)
    return d.select(*docs.columns, F.struct(
        F.col("__e").alias("evidence"), F.col("__hp").alias("host_p"), F.col("__pp").alias("path_p"),
        post.alias("p_quality"), (post >= threshold).alias("keep")).alias("quality_score"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The filtering stage: the rows of ``docs`` (same columns) that are kept."""
    return score_documents(docs, labels, **settings).where("quality_score.keep").select(*docs.columns)
