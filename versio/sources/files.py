"""File-level sources and sinks: checksums, prediction CSV, history
tables, and the guard against writing into a used output folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PREDICTIONS
from .appends import publish
from .csv_options import CSV_OPTIONS
from .digests import file_digests
from .histories import append_history, compact_history, export_history_csv, read_history


def verify_checksum(spark: SparkSession, path: str, expected: dict | DataFrame, glob: str | None = None) -> DataFrame:
    """Digests of the files under ``path`` compared with the pinned ones, by
    name below ``path`` (a dict, or a table ``name, expected_sha256``). Status
    ``ok``, ``mismatch``, ``unpinned`` (no pin) or ``absent`` (a pin without a
    file, whose other columns are null)."""
    pins = expected if isinstance(expected, DataFrame) else spark.createDataFrame(
        list(expected.items()), "name string, expected_sha256 string")
    status = (F.when(F.col("sha256").isNull(), "absent").when(F.col("expected_sha256").isNull(), "unpinned")
              .when(F.col("sha256") == F.lower("expected_sha256"), "ok").otherwise("mismatch"))
    return file_digests(spark, path, glob).join(pins, "name", "full").withColumn("status", status)


def verify_contents(rows: DataFrame, pins: DataFrame, name_col: str, content_col: str) -> DataFrame:
    """``(name, sha256, status)`` of every row: the digest of its content
    compared with ``pins`` (``name, expected_sha256``); ``ok``, ``mismatch`` or
    ``unpinned``. Both sides may be of any size: this is an ordinary join."""
    got = rows.select(F.col(name_col).alias("name"), F.sha2(F.col(content_col), 256).alias("sha256"))
    status = (F.when(F.col("expected_sha256").isNull(), "unpinned")
              .when(F.col("sha256").eqNullSafe(F.col("expected_sha256")), "ok").otherwise("mismatch"))
    return got.join(pins, "name", "left").select("name", "sha256", status.alias("status"))


def require_checksums(report: DataFrame) -> None:
    """Driver check on a checksum report (one row per file)."""
    bad = report.where(F.col("status") != "ok").select("name", "status").collect()
    if bad:
        raise ValueError(f"checksum verification failed: {[(r.name, r.status) for r in bad]}")


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``source, reference, prediction`` as CSV with a header; never overwrites by default."""
    texts = [F.when(F.startswith(F.col(c), F.lit("\\")), F.concat(F.lit("\\"), c)).otherwise(F.col(c)).alias(c)
             for c in ("source", "reference", "prediction")]
    predictions.select(*texts).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions CSV; an empty prediction cell reads as ``""``, never null
    (edit distance against null would drop the row from both sums)."""
    df = spark.read.schema(PREDICTIONS).options(**CSV_OPTIONS).option("multiLine", "true").csv(path)
    df = df.select(*[F.when(F.startswith(F.col(c), F.lit("\\")), F.substring(c, 2, 2**31 - 1)).otherwise(F.col(c)).alias(c)
                     for c in df.columns])
    return df.withColumn("prediction", F.coalesce(F.col("prediction"), F.lit("")))


def ensure_new_output(spark: SparkSession, path: str, resume: bool = False) -> None:
    """Refuse a non-empty output folder unless resuming (writers then use
    ``errorifexists`` so a race cannot overwrite either)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath) and fs.listStatus(jpath) and not resume:
        raise FileExistsError(f"output folder {path} is not empty; resume instead")


def claim_output(spark: SparkSession, path: str, resume: bool = False) -> None:
    """``ensure_new_output`` for runs that may start at the same time: of all
    that find the folder unused exactly one gets it, by creating its ``_claim``
    file. The others fail, as does a later run that does not resume."""
    ensure_new_output(spark, path, resume)
    if not publish(spark, f"{path}/_claim", uuid.uuid4().hex) and not resume:
        raise FileExistsError(f"output folder {path} was taken by another run; resume instead")


__all__ = ["CSV_OPTIONS", "append_history", "claim_output", "compact_history", "ensure_new_output", "export_history_csv", "file_digests", "read_history",
           "read_predictions", "require_checksums", "verify_checksum", "verify_contents", "write_predictions"]
