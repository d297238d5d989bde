"""Deterministic sharded WARC archives.

Records are sorted by page (range sort of keys, then of rows within their
shard), dealt to shards of equally many distinct pages, and written as one gzip
member each; a file is rolled when its compressed size reaches a bound. Headers
and digests are made from the payload. Files get temporary names of the task
attempt that writes them; a table of the attempts that Spark committed says
which of them are renamed, and the manifest, written last, is what a reader
trusts. The same pages give the same files, whatever the partitions were.

Payloads of at least ``min_bytes`` that occur again are stored once, in the
record of the smallest page id; the others are revisit records. Only keys decide
that (id, url, digest), so a payload is shuffled once, to its shard.
"""

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import exact_rank, remove_table
from .common import checked_broadcast, materialize, shared_path

#: Distinct pages of a shard (more if there would be over ``SHARDS`` shards),
#: compressed bytes from which a file is rolled, and bytes read at a time.
SHARD_PAGES, SHARDS, ROLL_BYTES, CHUNK = 1024, 20_000, 64 << 20, 1 << 20
#: Keys of copies that a task remembers, to send a payload only once.
SEEN = 100_000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _record_id(page, url, digest: bytes, copy: int) -> str:
    key = repr((page, url, digest.hex(), copy)).encode("utf-8", "replace")
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(key).digest()[:16], version=4)}>"


def _plain_url(url: str) -> str:
    """The URL as one header line: white space and control characters escaped."""
    return quote(url, safe="".join(map(chr, range(33, 127))), errors="replace")


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member; headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    head = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()
    return gzip.compress(head + block + b"\r\n\r\n", mtime=0)


def page_record(page, url, digest: bytes, size: int, payload: bytes | None, copy: int, date: str, refers=None) -> bytes:
    """A response record with ``payload``, or a revisit of ``refers`` (its
    page, url and copy) without one; ``size`` is the payload's in both cases."""
    http = HTTP.format(size).encode()
    name = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", _record_id(page, url, digest, copy)), ("WARC-Date", date),
            ("WARC-Target-URI", None if url is None else _plain_url(url)), ("X-Page-ID", None if page is None else quote(str(page), safe="")),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest.hex()}")]
    if refers:
        to, at, n = refers
        name += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(to, at, digest, n)), ("WARC-Refers-To-Date", date),
                 ("WARC-Refers-To-Target-URI", None if at is None else _plain_url(at)),
                 ("X-Refers-To-Page-ID", None if to is None else quote(str(to), safe=""))]
    return _member(name, http if refers else http + payload)


class _Roller:
    """The files of one shard, under temporary names of this attempt."""

    def __init__(self, folder: str, shard: str, roll_bytes: int, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.date, self.files, self.out = shard, roll_bytes, date, 0, None

    def add(self, member: bytes) -> dict | None:
        """Writes a record; the manifest row of the file if that filled it."""
        if self.out is None:
            self.name = f"{self.shard}-{self.files:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.files, self.records, self.bytes, self.sha = self.files + 1, 0, 0, hashlib.sha256()
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name, b"", 0)), ("WARC-Date", self.date),
                     ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(_member(about, b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1
        return self.close() if self.bytes >= self.roll_bytes else None

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.bytes += len(member)
        self.sha.update(member)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def _sort_key(page, url, digest) -> tuple:
    """The order of pages: id (null last), url (null first), digest."""
    return (page is None, 0 if page is None else page, url is not None, url or "", digest)


def _keys(pages: DataFrame, min_bytes: int) -> DataFrame:
    """The distinct pages in order, as a written table: ``page, url, digest,
    bytes, copies, small`` (a payload under ``min_bytes``) and ``rank``."""
    keys = pages.groupBy("page", "url", "digest", "bytes").agg(
        F.count("*").alias("copies"), F.first(F.when(F.col("bytes") < min_bytes, F.col("html"))).alias("small"))
    return exact_rank(keys, [F.col("page").asc_nulls_last(), F.col("url").asc_nulls_first(), "digest"])


def _entries(keys: DataFrame, size: int, min_bytes: int) -> DataFrame:
    """What to write: per page and shard the number of copies, the number of
    the first of them, and the page that is revisited."""
    place = F.struct(F.col("page").isNull().alias("none"), "page", F.col("url").isNotNull().alias("named"), "url")
    first = (keys.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(place).alias("f"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("digest").alias("d"), "f"))
    first = checked_broadcast(materialize(first, "warc-first"))
    d = keys.join(first, keys["digest"] == first["d"], "left")
    d = d.withColumn("refers", F.col("f").isNotNull() & (F.col("f") != place))
    # copies of one page beyond a shard's worth go to shards beside it
    d = d.withColumn("beside", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / size))))
    return d.select(F.floor((F.col("rank") - 1) / size).alias("shard"), "beside", "page", "url", "digest", "bytes", F.lit(0).alias("kind"),
                    (F.col("beside") * size).alias("from_copy"), F.least(F.lit(size).cast("long"), F.col("copies") - F.col("beside") * size).alias("n"),
                    "refers", F.col("f.page").alias("to_page"), F.col("f.url").alias("to_url"), F.col("small").alias("html"))


def _payloads(pages: DataFrame, keys: DataFrame, size: int, min_bytes: int) -> DataFrame:
    """The pages with a payload of ``min_bytes``, by the shard of their place
    in the order; a task sends one copy of a page (as far as it remembers)."""
    starts = keys.where((F.col("rank") - 1) % size == 0).select("page", "url", "digest").collect()  # at most SHARDS
    starts = pages.sparkSession.sparkContext.broadcast(sorted(_sort_key(*r) for r in starts))

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        seen, at = set(), starts.value
        for cols in batches:
            out = []
            for key in zip(*(c.to_pylist() for c in cols), strict=True):
                out.append(-1 if key in seen else bisect_right(at, _sort_key(*key)) - 1)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            yield pa.array(out, pa.int64())

    shard = F.arrow_udf(run, "long").asNondeterministic()
    d = pages.where(F.col("bytes") >= min_bytes).withColumn("shard", shard("page", "url", "digest")).where("shard >= 0")
    return d.select("shard", F.lit(0).cast("long").alias("beside"), "page", "url", "digest", F.lit(1).alias("kind"), "html")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_bytes: int = 100, shard_pages: int = SHARD_PAGES, roll_bytes: int = ROLL_BYTES,
               date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` to a new ``folder`` and returns its
    manifest ``name, records, bytes, sha256``.

    ``folder`` is on storage that all nodes share and that ``pyarrow.fs`` can
    write. A null payload is empty; a null id or url has no header; a repeated
    row is a copy and gets a record of its own; of equal payloads and ids the
    smallest url comes first; other columns are not read; an empty table gives
    a manifest without files. A folder with a manifest is never written to."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    d = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"),
                     F.octet_length(html).cast("long").alias("bytes"), F.unhex(F.sha2(html, 256)).alias("digest"))
    keys = _keys(d, min_bytes)
    size = max(shard_pages, -(-keys.count() // SHARDS))
    # entries are small; payloads are moved once, to the shard of their entry
    rows = _entries(keys, size, min_bytes).unionByName(_payloads(d, keys, size, min_bytes), allowMissingColumns=True)
    order = [F.col("shard"), F.col("beside"), F.col("page").asc_nulls_last(), F.col("url").asc_nulls_first(), F.col("digest"), F.col("kind")]
    rows = rows.repartition("shard", "beside").sortWithinPartitions(*order)
    names = ["name", "temporary", "records", "bytes", "sha256"]
    schema = "name string, temporary string, records long, bytes long, sha256 string"
    kind = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = roller = waits = None

        def members(r, key):
            """The records that a row brings: its copies, or what waited for the payload."""
            nonlocal waits
            if r["kind"]:
                e, waits = (waits, None) if waits is not None and waits[0] == key else (None, waits)
                if e is not None:
                    e = e[1]
                    yield page_record(*key, e["bytes"], r["html"].encode("utf-8", "replace"), 0, date)
                    for i in range(1, e["n"]):
                        yield page_record(*key, e["bytes"], None, i, date, (key[0], key[1], 0))
                return
            waits = None
            if r["bytes"] < min_bytes:
                for i in range(r["n"]):
                    yield page_record(*key, r["bytes"], r["html"].encode("utf-8", "replace"), r["from_copy"] + i, date)
            elif not r["refers"] and not r["from_copy"]:
                waits = key, r
            else:
                to = (r["to_page"], r["to_url"], 0) if r["refers"] else (key[0], key[1], 0)
                for i in range(r["n"]):
                    yield page_record(*key, r["bytes"], None, r["from_copy"] + i, date, to)

        def told(rows):
            return pa.RecordBatch.from_pylist(rows, kind)

        for b in batches:
            done = []
            for i in range(b.num_rows):
                r = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
                if now != (r["shard"], r["beside"]):
                    done += [roller.close()] if roller is not None else []
                    now = r["shard"], r["beside"]
                    roller = _Roller(folder, f"{now[0]:06d}.{now[1]:06d}", roll_bytes, date)
                for m in members(r, (r["page"], r["url"], r["digest"])):
                    done.append(roller.add(m))
            done = [f for f in done if f]
            if done:
                yield told(done)
        last = roller.close() if roller is not None else None
        if last:
            yield told([last])

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """May run again for a file: then it has its name already."""
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, temporary, size in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if fs.get_file_info(f"{root}/{temporary}").type == pafs.FileType.File:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                if fs.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name} in {folder} is not the file that was written")
            yield b.select(["name", "records", "bytes", "sha256"])

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileExistsError(f"{folder} has an archive already")
    rows.mapInArrow(write, schema).select(*names).write.parquet(f"{folder}/_written")
    written = spark.read.schema(schema).parquet(f"{folder}/_written")
    written.mapInArrow(rename, "name string, records long, bytes long, sha256 string").write.parquet(f"{folder}/manifest")
    for left in ("_written", "_temporary"):
        remove_table(spark, f"{folder}/{left}")
    return spark.read.schema("name string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")


def _members(stream, sha) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed; ``sha`` digests the file."""
    left, unzip, parts = b"", zlib.decompressobj(31), []
    while chunk := left or stream.read(CHUNK):
        if not left:
            sha.update(chunk)
        parts.append(unzip.decompress(chunk))
        left = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; a block that is not whole, or not what
    its digest says, is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block, end = rest[:int(headers["Content-Length"])], rest[int(headers["Content-Length"]):]
    if version != "WARC/1.1" or end != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    return headers, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of the archive's files that its manifest lists:
    ``page, url, record_type, record_id, payload_bytes, payload_digest,
    refers_to, html`` (null in revisits), all but the size as strings. A file
    that differs from the manifest is an error. Files are read in pieces."""
    names = ["page", "url", "record_type", "record_id", "payload_bytes", "payload_digest", "refers_to", "html"]
    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        kind = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        for b in batches:
            for name, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sha, rows, held = hashlib.sha256(), [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream, sha):
                        h, block = parse_record(record)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        whole = h["WARC-Type"] == "response"
                        size, digest = int(http.rpartition(b"Content-Length: ")[2]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"broken payload in {h['WARC-Record-ID']}")
                        ids = [None if h.get(k) is None else unquote(h[k]) for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                        rows.append(dict(zip(names, (ids[0], h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Record-ID"], size, digest, ids[1],
                                                     payload.decode() if whole else None), strict=True)))
                        held += len(payload)
                        if held >= 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                if sha.hexdigest() != want:
                    raise ValueError(f"{name} is not the file of the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.schema("name string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    each = max(1, min(files.count(), SHARDS))  # few small rows, a file each
    return files.select("name", "sha256").repartition(each).mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """``write_warc``, by default to a folder of its own in the shared one, and ``read_warc``."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    write_warc(pages, folder, **settings)
    return read_warc(pages.sparkSession, folder)
