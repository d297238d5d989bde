"""Tables that grow by appends which may be repeated.

An append writes its rows into a folder of its own and becomes part of the table
only by its entry in the log, a file that exactly one writer can create under
its number. What a crash leaves before that is never read; an append that names
a key is entered once, however often it is repeated. Readers take the folders
that the log lists, and by key columns the newest row.
"""

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_log"


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with ``text`` unless it exists: of any number of
    writers exactly one gets True. The whole text appears at once: a file of a
    temporary name is linked (local) or renamed without overwriting (others, as
    far as their store renames atomically)."""
    fs, jpath = _file_system(spark, path)
    fs.mkdirs(jpath.getParent())
    if fs.getUri().getScheme() == "file":
        final = unquote(urlparse(str(jpath.toUri().toString())).path)
        temporary = f"{os.path.dirname(final)}/.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, final)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(jpath.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(jpath) and fs.rename(temporary, jpath):
        return True
    fs.delete(temporary, False)
    return False


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def log_entries(spark: SparkSession, path: str) -> list[dict]:
    """The table's appends in order: ``n``, ``append`` and ``key``, and of a
    compaction ``upto``, the last append it holds, and their keys ``held``. One
    small file an append."""
    fs, jpath = _file_system(spark, f"{path}/{LOG}")
    if not fs.exists(jpath):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(jpath))
    return [json.loads(read_text(spark, f"{path}/{LOG}/{n}")) | {"n": int(n)} for n in names if n.isdigit()]


def _has(entries: list[dict], key: str | None) -> bool:
    return key is not None and any(key == e["key"] or key in e.get("held", ()) for e in entries)


def append_rows(rows: DataFrame, path: str, key: str | None = None) -> bool:
    """Add ``rows`` to the table at ``path``; False if an append with this
    ``key`` is there already."""
    if _has(log_entries(rows.sparkSession, path), key):
        return False
    return _enter(rows, path, {"key": key})


def _enter(rows: DataFrame, path: str, entry: dict) -> bool:
    """Write the rows, then their log entry under the next free number."""
    spark = rows.sparkSession
    entry = {"append": f"a{uuid.uuid4().hex}", **entry}
    rows.write.mode("errorifexists").parquet(f"{path}/append={entry['append']}")
    while True:  # again if another writer took the number
        entries = log_entries(spark, path)
        if _has(entries, entry["key"]):
            return False
        n = max((e["n"] for e in entries), default=0) + 1
        if publish(spark, f"{path}/{LOG}/{n:012d}", json.dumps(entry)):
            return True


def _live(entries: list[dict]) -> list[dict]:
    """The appends that make up the table: the compaction that reaches
    furthest, and what came after the appends it holds."""
    whole = max((e for e in entries if "upto" in e), key=lambda e: (e["upto"], e["n"]), default=None)
    upto = whole["upto"] if whole else 0
    return ([whole] if whole else []) + [e for e in entries if "upto" not in e and e["n"] > upto]


def _rows(spark: SparkSession, path: str, entries: list[dict], key_cols) -> DataFrame | None:
    live = _live(entries)
    if not live:
        return None
    reader = spark.read.option("basePath", path).option("mergeSchema", "true")
    rows = reader.parquet(*[f"{path}/append={e['append']}" for e in live])
    # one row an append; a compacted one is as old as the last it holds
    age = spark.createDataFrame([(e["append"], e.get("upto", e["n"])) for e in live], "append string, _n long")
    cols = [c for c in rows.columns if c != "append"]
    newest = rows.join(F.broadcast(age), "append").groupBy(*[c for c in key_cols if c in cols]).agg(
        F.max_by(F.struct(*cols), "_n").alias("_row"))
    return newest.select("_row.*")


def read_rows(spark: SparkSession, path: str, key_cols) -> DataFrame | None:
    """The rows of the table, the newest one per ``key_cols`` (those the table
    has); None for a table without appends."""
    return _rows(spark, path, log_entries(spark, path), key_cols)


def compact(spark: SparkSession, path: str, key_cols) -> None:
    """Rewrite the current rows as one append that stands for all it was read
    from; what comes in meanwhile stays beside it."""
    entries = log_entries(spark, path)
    rows = _rows(spark, path, entries, key_cols)
    if rows is not None:
        held = {e["key"] for e in entries if e["key"] is not None}.union(*(e.get("held", ()) for e in entries))
        _enter(rows, path, {"key": None, "upto": max(e.get("upto", e["n"]) for e in entries), "held": sorted(held)})
