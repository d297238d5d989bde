"""Data manifest of a run and the gate that compares two runs."""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The manifest keys whose change blocks a resume, and the one
# that only warns.
BLOCKING_KEYS = ["source", "original_examples", "selected_examples", "split_before_filter",
                 "split_after_filter", "source_vocab_size", "target_vocab_size", "split_seed",
                 "tokenizer_training_split"]
WARNING_KEYS = ["software"]


def manifest_counts(split: DataFrame, kept: DataFrame, vocab: DataFrame, src: str, tgt: str) -> DataFrame:
    """One row of every count in the manifest, from one aggregate per input
    (all ``count_if`` in a single pass each)."""
    def per_split(df, suffix):
        return df.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_{suffix}")
                        for s in ("train", "val", "test")])

    sizes = vocab.agg(F.count_if(F.col("lang") == src).alias("source_vocab_size"),
                      F.count_if(F.col("lang") == tgt).alias("target_vocab_size"))
    totals = split.agg(F.max("selected").alias("selected_examples"), F.max("total").alias("original_examples"))
    from .metrics import one_row
    return one_row(totals, per_split(split, "before"), per_split(kept, "after"), sizes)


def corpus_digest(pairs: DataFrame, src: str = "en", tgt: str = "it") -> str:
    """A digest of a pair table's content that does not depend on the order of
    its rows: their number, and the sum of 256-bit row digests in four parts,
    from one aggregation."""
    text = F.to_json(F.struct(F.col("id"), F.col(f"translation.{src}").alias("s"), F.col(f"translation.{tgt}").alias("t")),
                     {"ignoreNullFields": "false"})
    row = pairs.select(F.sha2(text, 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 16 * i + 1, 15), 16, 10).cast("decimal(38,0)"))
    got = row.agg(F.count(F.lit(1)), *[part(i) for i in range(4)]).first()
    return hashlib.sha256(":".join(str(x) for x in got).encode()).hexdigest()


def data_manifest(counts: DataFrame, seed: int, source: dict,
                  software: dict | None = None, run_id: str = "run") -> DataFrame:
    """Nested manifest row (``to_json`` gives the stored document). All counts
    come from ``manifest_counts``; the corpus is not read again."""
    c = counts
    src = F.struct(*[F.lit(v).alias(k) for k, v in source.items()])
    soft = F.create_map(*[x for k, v in (software or {}).items() for x in (F.lit(k), F.lit(v))]) \
        if software else F.create_map().cast("map<string,string>")
    split_struct = lambda suffix: F.struct(*[F.col(f"{s}_{suffix}").cast("int").alias(s)
                                             for s in ("train", "val", "test")])
    return c.select(
        F.lit(run_id).alias("run_id"), src.alias("source"),
        F.col("original_examples").cast("int").alias("original_examples"),
        F.col("selected_examples").cast("int").alias("selected_examples"),
        split_struct("before").alias("split_before_filter"),
        split_struct("after").alias("split_after_filter"),
        F.col("source_vocab_size").cast("int").alias("source_vocab_size"),
        F.col("target_vocab_size").cast("int").alias("target_vocab_size"),
        F.lit(int(seed)).alias("split_seed"), F.lit("train").alias("tokenizer_training_split"),
        soft.alias("software"))


def manifest_long(manifest: DataFrame, run_col: str = "run_id") -> DataFrame:
    """``(run_id, key, value)`` with every value as canonical JSON text."""
    keys = [c for c in manifest.columns if c != run_col]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.to_json(F.struct(F.col(k).alias("v"))).alias("value"))
                      for k in keys])
    return manifest.select(run_col, F.explode(pairs).alias("_kv")).select(
        run_col, "_kv.key", "_kv.value")


def manifest_diff(long: DataFrame, baseline_run: str, run_col: str = "run_id") -> DataFrame:
    """Every other run compared key by key with the baseline run.

    ``severity`` is ``block`` for a differing blocking key, ``warn`` for a
    differing software key and ``same`` otherwise; keys outside both lists
    (the fingerprint) are ``ignored``. A key that only one of the two has
    differs, on either side.
    """
    base = long.where(F.col(run_col) == baseline_run).select("key", F.col("value").alias("baseline_value"))
    cand = long.where(F.col(run_col) != baseline_run).select(run_col, "key", "value")
    # every run gets a row for each known key, also for those it lacks
    known = F.explode(F.array(*[F.lit(k) for k in BLOCKING_KEYS + WARNING_KEYS])).alias("key")
    lacking = cand.select(run_col).distinct().select(run_col, known, F.lit(None).cast("string").alias("value"))
    cand = cand.unionByName(lacking).groupBy(run_col, "key").agg(F.max("value").alias("value"))
    joined = cand.join(base, "key", "left").where(F.col("value").isNotNull() | F.col("baseline_value").isNotNull())
    same = F.col("value").eqNullSafe(F.col("baseline_value"))
    severity = (F.when(~F.col("key").isin(BLOCKING_KEYS + WARNING_KEYS), F.lit("ignored"))
                .when(same, F.lit("same"))
                .when(F.col("key").isin(WARNING_KEYS), F.lit("warn"))
                .otherwise(F.lit("block")))
    return joined.select(run_col, "key", "baseline_value", "value", severity.alias("severity"))


def resume_allowed(diff: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per run: no blocking difference (resume allowed) and the number of warnings."""
    return diff.groupBy(run_col).agg(
        (F.count_if(F.col("severity") == "block") == 0).alias("resume_allowed"),
        F.count_if(F.col("severity") == "warn").alias("warnings"))
