"""WARC archives with a two-level capture index.

Archives: one file a task, each record a gzip member of its own. Index: capture
lines sorted by reversed-host URL key, cut into shards by key range; a shard is a
file of compressed blocks of lines with a sparse directory (first key, offset and
length of each block) in a file beside it. A look-up finds the shard by binary
search in the shards' first keys, the block by binary search in the shard's
directory, reads and inflates that block alone, finds the line by binary search and
reads the record by its byte range. Look-ups come sorted, so a block is read once.

All files lie in the shared folder and are opened by its URI. A task attempt writes
files of its own; only those of attempts that Spark commits are referred to.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import new_path, stage, tasks

#: Least payload that a revisit record may stand for; index lines of a block and (about) of a shard.
REVISIT_BYTES, BLOCK_LINES, SHARD_LINES = 100, 300, 1_000_000
#: Bytes of records (compressed) that a task reads.
READ_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", re.I | re.S)
_BAD = re.compile(r"[\x00-\x20\x7f%]")


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``http://a.b.org/x?y#z`` gives ``org,b,a)/x?y``. Control characters, spaces and % are escaped; no URL gives ``)``."""
    m = _URL.match(url or "")
    if not m:
        return ")" + _BAD.sub(lambda x: f"%{ord(x[0]):02X}", url or "")
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return _BAD.sub(lambda x: f"%{ord(x[0]):02X}", f"{','.join(reversed(m[1].lower().split('.')))}{port}){m[3] or '/'}")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'' if page_id is None else page_id}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Hadoop's names of the S3 scheme are pyarrow's ``s3``."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_BAD.sub(lambda x: f'%{ord(x[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; the digest of a response is of the payload read, and must equal the one written."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda s: int(s[10:-1]) if s and len(s) > 11 else None
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {h['WARC-Record-ID']}: the payload does not match its digest")
    return {"page_id": number(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number(h.get("WARC-Refers-To")), "payload": payload}


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        t = TaskContext.get()
        name, out, at = f"pages-{t.partitionId():06d}-{t.taskAttemptId()}.warc.gz", None, 0
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            rows = []
            for page_id, url, html, digest, ref in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, html = page_id.as_py(), url.as_py(), html.as_py()
                z = zlib.compressobj(2, zlib.DEFLATED, 31)
                m = z.compress(record(page_id, url, (html or "").encode(), digest.as_py(), ref.as_py())) + z.flush()
                out.write(m)
                rows.append((capture_key(url, page_id), name, at, len(m)))
                at += len(m)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], k) for k in (pa.string(), pa.string(), pa.int64(), pa.int64())], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        t = TaskContext.get()
        name, out, at, lines, sparse, total = f"shard-{t.partitionId():06d}-{t.taskAttemptId()}", None, 0, [], [], 0

        def block() -> None:
            nonlocal at, total
            z = zlib.compress("\n".join(lines).encode(), 6)
            out.write(z)
            sparse.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(z)}")
            at += len(z)
            total += len(lines)
            lines.clear()

        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(f"{path}/{name}.cdx.z", compression=None)
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) >= BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as f:
                f.write("\n".join(sparse).encode())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sparse[0].split("\t", 1)[0]]), pa.array([total], pa.int64())], names=["shard", "first_key", "lines"])

    return run


class ShardReader:
    """Look-ups in one index; keeps the directory and the block last used."""

    def __init__(self, folder: str, first_keys: list[str], shards: list[str]):
        (self.fs, self.path), self.first_keys, self.shards = _open(folder), first_keys, shards
        self.shard, self.block = -1, None

    def _load(self, i: int) -> None:
        with self.fs.open_input_stream(f"{self.path}/{self.shards[i]}.dir", compression=None) as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")]
        self.keys, self.spans = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.file = self.fs.open_input_file(f"{self.path}/{self.shards[i]}.cdx.z")
        self.shard, self.block = i, None

    def _lines(self, b: int) -> list[list[str]]:
        if self.block != b:
            off, n = self.spans[b]
            self.file.seek(off)
            self.rows = [x.split("\t") for x in zlib.decompress(self.file.read(n)).decode().split("\n")]
            self.row_keys = [r[0] for r in self.rows]
            self.block = b
        return self.rows

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture of the key; equal keys may run over blocks and shards."""
        i = max(bisect.bisect_left(self.first_keys, key) - 1, 0)
        while i < len(self.shards) and (i == 0 or self.first_keys[i] <= key):
            if self.shard != i:
                self._load(i)
            b = max(bisect.bisect_left(self.keys, key) - 1, 0)
            while b < len(self.keys) and self.keys[b] <= key:
                rows = self._lines(b)
                j = bisect.bisect_left(self.row_keys, key)
                while j < len(rows) and rows[j][0] == key:
                    yield rows[j][1], int(rows[j][2]), int(rows[j][3])
                    j += 1
                b += 1
            i += 1


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record under ``folder``; captures (key, file, offset, length).

    Of payloads of at least REVISIT_BYTES that are equal, the one with the smallest
    page_id is the response and the others revisit it; of rows that repeat that page_id
    the first by url is. A row with a null page_id is a response. A null html is an
    empty payload. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    ids = p.where(F.octet_length("html") >= REVISIT_BYTES).where("page_id IS NOT NULL").select("page_id", F.unhex(digest).alias("d"))
    ids = ids.groupBy("d", "page_id").agg(F.count("*").alias("n"))  # a payload of a third of all pages meets as ids alone
    firsts = ids.groupBy("d").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.min_by("n", "page_id").alias("n")).where("first < last OR n > 1").drop("last")
    firsts = stage(firsts, "firsts")
    p = p.withColumn("digest", digest).join(firsts, F.unhex("digest") == F.col("d"), "left")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    out = lambda df, r: df.select("page_id", "url", "html", "digest", r.alias("refers_to"))
    if firsts.where("n > 1").limit(1).count():
        own = F.coalesce((F.col("page_id") == F.col("first")) & (F.col("n") > 1), F.lit(False))
        again = p.where(own).withColumn("nth", F.row_number().over(Window.partitionBy("d", "page_id").orderBy("url")))
        p = out(p.where(~own), refers).unionByName(out(again, F.when(F.col("nth") > 1, F.col("first"))))
    else:
        p = out(p, refers)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    return stage(p.mapInArrow(_archive(folder), "key string, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, lines: int) -> DataFrame:
    """Sort captures by key into shards under ``folder``; the shards (shard, first_key, lines), one row for about SHARD_LINES captures."""
    spark = captures.sparkSession
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    shards = captures.repartitionByRange(tasks(spark, lines, SHARD_LINES, 10 * BLOCK_LINES), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return stage(shards.mapInArrow(_index(folder), "shard string, first_key string, lines long"), "shards")


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures (file, offset, length) of each distinct ``key``, by the index alone."""
    rows = shards.orderBy("first_key", "shard").collect()  # one row for SHARD_LINES captures
    first_keys, names = [r["first_key"] for r in rows], [r["shard"] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(folder, first_keys, names)
        for batch in batches:
            got = [x for k in batch.column(0).to_pylist() for x in reader.find(k)] if names else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names=["file", "offset", "length"])

    k = keys.select("key").distinct()
    k = k.repartitionByRange(tasks(keys.sparkSession, sum(r["lines"] for r in rows), SHARD_LINES, 10 * BLOCK_LINES), "key").sortWithinPartitions("key")
    return k.mapInArrow(run, "file string, offset long, length long")


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records in these byte ranges, read in file order; ``payloads`` adds the payload of responses."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if payloads else 5]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name = f = None
        for batch in batches:
            rows = []
            for file, off, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != name:
                    name, f = file, fs.open_input_file(f"{path}/{file}")
                f.seek(off)
                rows.append(parse(zlib.decompress(f.read(n), 31)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=False)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    size = captures.agg(F.sum("length").alias("n")).first()["n"]
    c = captures.repartitionByRange(tasks(captures.sparkSession, size, READ_BYTES, READ_BYTES >> 6), "file", "offset").sortWithinPartitions("file", "offset")
    return c.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and their index, look every page up by its URL key and read its record back; one row per page. An empty table gives no rows."""
    spark = pages.sparkSession
    warcs, cdx = new_path(spark, "warc"), new_path(spark, "cdx")
    captures = write_archives(pages, warcs)
    shards = write_index(captures, cdx, captures.count())

    @F.arrow_udf("string")
    def key(url: pa.Array, page_id: pa.Array) -> pa.Array:
        return pa.array([capture_key(u, p) for u, p in zip(url.to_pylist(), page_id.to_pylist(), strict=True)], pa.string())

    keys = pages.select(key(F.col("url").cast("string"), F.col("page_id").cast("long")).alias("key"))
    return read_records(stage(look_up(keys, shards, cdx), "found"), warcs)
