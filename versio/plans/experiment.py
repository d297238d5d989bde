"""The data half of an experiment run, with the artifacts its folder keeps.

``prepare_run`` refuses a used run folder unless resuming, reuses a stored
vocabulary, writes the model inputs and the data manifest, and on resume
compares the new manifest with the stored one: a changed blocking key
stops the run, a changed software version only warns.
"""

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest as M
from ..operators.vocab import load_or_train_vocab
from ..sources.files import claim_output
from .prepare import Prepared, prepare, split_pairs


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def prepare_run(spark: SparkSession, pairs: DataFrame, run_dir: str, seed: int = 42,
                max_samples: int | None = None, seq_len: int = 128, src: str = "en", tgt: str = "it",
                resume: bool = False, source: dict | None = None,
                software: dict | None = None) -> tuple[Prepared, DataFrame]:
    """``(prepared, manifest)``; writes ``vocab/``, ``model_inputs/`` and
    ``data_manifest/`` (one JSON document) under ``run_dir``."""
    claim_output(spark, run_dir, resume=resume)
    split = split_pairs(pairs, seed, max_samples, src, tgt)
    vocab = load_or_train_vocab(spark, f"{run_dir}/vocab", split, {src: "src_text", tgt: "tgt_text"})
    prepared = prepare(pairs, seed, max_samples, seq_len, src, tgt, with_decoder_mask=False,
                       vocab=vocab, split=split)
    software = software or {"pyspark": spark.version}
    # the content's digest is part of the source: a changed corpus with the
    # same counts is another source
    source = (source or {"kind": "parquet"}) | {"sha256": M.corpus_digest(pairs, src, tgt)}
    manifest = M.data_manifest(M.manifest_counts(prepared.split, prepared.kept, vocab, src, tgt),
                               seed, source, software, run_id="current")
    manifest_path, inputs_path = f"{run_dir}/data_manifest", f"{run_dir}/model_inputs"
    if resume and _exists(spark, f"{manifest_path}/_SUCCESS"):
        previous = spark.read.schema(manifest.schema).json(manifest_path).withColumn("run_id", F.lit("previous"))
        diff = M.manifest_diff(M.manifest_long(previous.unionByName(manifest)), "previous")
        verdict = {r["key"]: r["severity"] for r in diff.collect()}  # one row per manifest key
        blocked = sorted(k for k, v in verdict.items() if v == "block")
        if blocked:
            raise ValueError(f"data, split or vocabulary differ from the stored run ({blocked}); cannot resume")
        if any(v == "warn" for v in verdict.values()):
            warnings.warn("software versions differ from the stored run; results may differ slightly")
    # inputs first, manifest last: a manifest means that everything is there,
    # and a resumed run writes what a stopped one did not finish
    mode = "overwrite" if resume else "errorifexists"
    if not (resume and _exists(spark, f"{inputs_path}/_SUCCESS")):
        prepared.inputs.write.mode(mode).parquet(inputs_path)
    if not (resume and _exists(spark, f"{manifest_path}/_SUCCESS")):
        manifest.drop("run_id").coalesce(1).write.mode(mode).json(manifest_path)
    return prepared, manifest
