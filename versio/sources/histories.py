"""History tables: typed CSV read by column name, and appends by epoch that may
be repeated (see ``appends``)."""

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HISTORY
from .appends import append_rows, compact, read_rows
from .csv_options import CSV_OPTIONS

RUN = T.StructField("run_id", T.StringType())
KEY = ("run_id", "epoch")
#: Columns without which a file is no history; the others may be absent.
REQUIRED = ("epoch", "train_loss", "val_loss")
#: Stands for an empty cell while reading, so that a written null is told from it.
EMPTY = "\x01"


def append_history(history: DataFrame, path: str, key: str | None = None) -> bool:
    """Add epoch rows to a history table (Parquet, schema fixed). An epoch of a
    run that is there already is replaced, so an append may be repeated; one
    with a ``key`` that was appended before does nothing and returns False. Two
    different rows for one epoch in ``history`` are an error."""
    run = [F.col("run_id").cast("string")] if "run_id" in history.columns else []
    rows = history.select(*run, *[F.col(f.name).cast(f.dataType) for f in HISTORY.fields]).distinct()
    keys = [c for c in KEY if c in rows.columns]
    twice = rows.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"different rows for the same epoch: {[tuple(r)[:-1] for r in twice]}")
    return append_rows(rows, path, key)


def compact_history(spark: SparkSession, path: str) -> None:
    """Rewrite a history table of many appends as one."""
    compact(spark, path, KEY)


def export_history_csv(history: DataFrame, path: str) -> None:
    """History rows as CSV with their ``run_id``, if they have one; a used
    folder is never overwritten."""
    run = [c for c in history.columns if c == "run_id"]
    history.select(*run, *[f.name for f in HISTORY.fields]).write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The different header lines of the files under ``path``, and their files."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("i"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "i").alias("header"))
    return {r["header"]: r["files"] for r in first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()}


def _rows_of(spark: SparkSession, paths, header: str) -> DataFrame:
    """``run_id`` and the history columns of files with this header, by name,
    and ``problem``: what is wrong with the row, or null."""
    names = next(csv.reader([header.lstrip("﻿")]))
    wanted = [RUN, *HISTORY.fields]
    missing = [c for c in REQUIRED if c not in names]
    repeated = [f.name for f in wanted if names.count(f.name) > 1]
    if missing or repeated:
        raise ValueError(f"history header {names}: missing {missing}, repeated {repeated}")
    cells = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "line"]])
    options = CSV_OPTIONS | {"nullValue": EMPTY, "columnNameOfCorruptRecord": "line", "mode": "PERMISSIVE", "columnPruning": "false"}
    rows = spark.read.schema(schema).options(**options).csv(paths)
    values, problems = [], [F.when(F.col("line").isNotNull(), F.lit("not as many cells as the header"))]
    for f in wanted:
        if f.name not in names:
            values.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        cell = F.col(cells[names.index(f.name)])
        kind = f.dataType.simpleString()
        value = F.when(cell != "\\N", cell if kind == "string" else cell.try_cast(kind))
        bad = cell.isNull() & F.lit(f.name != "run_id") | (cell != "\\N") & value.isNull()
        if f.name == "epoch":
            bad = value.isNull()
        problems.append(F.when(bad, F.concat(F.lit(f"{f.name} is "), F.coalesce(F.concat(F.lit("'"), cell, F.lit("'")), F.lit("empty")))))
        values.append(value.alias(f.name))
    problem = F.concat_ws("; ", *problems)
    return rows.select(*values, F.when(problem != "", problem).alias("problem"), F.lit("run_id" in names).alias("named"))


def checked_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The CSV history at ``path`` as ``(rows, quarantine)``.

    Columns are found by the names in each file's header, in whatever order,
    others are passed over; ``epoch``, ``train_loss`` and ``val_loss`` must be
    there. A row with an empty cell, one that is no number, or more or fewer
    cells than the header goes to the quarantine with its ``problem``; ``\\N``
    is a null that was written as such (never the epoch). ``run_id`` is a column
    if some file has it. A path without any row is an error."""
    headers = _headers(spark, path)
    if not headers:
        raise ValueError(f"history at {path} has no epochs")
    parts = [_rows_of(spark, path if len(headers) == 1 else [unquote(f) for f in files], header)
             for header, files in sorted(headers.items())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    with_runs = any("run_id" in next(csv.reader([h.lstrip("﻿")])) for h in headers)
    names = ([RUN.name] if with_runs else []) + HISTORY.names
    return rows.where("problem IS NULL").select(*names), rows.where("problem IS NOT NULL").select(*names, "problem")


def read_history(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Typed history read. For CSV a broken row is an error (see
    ``checked_history`` to set such rows aside); Parquet is a table of
    ``append_history`` or plain files. An empty history is an error."""
    if fmt == "csv":
        df, bad = checked_history(spark, path)
        found = bad.limit(5).collect()
        if found:
            raise ValueError(f"history at {path} has broken rows: {[r['problem'] for r in found]}")
    else:
        df = read_rows(spark, path, KEY)
        if df is None:
            df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"history at {path} has no epochs")
    return df
