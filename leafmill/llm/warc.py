"""WARC archives: pages to records, monolithic gzip files to files with a member a record, and reading by a sidecar index.

Writing.  Each task writes its pages, where they are, as WARC/1.1 response records into whole-file gzip streams (one member for all records) and
returns a row a record: file, number in it, id, payload size and SHA-1.  Pages are not shuffled.

Repeats.  Which records repeat a payload is decided over these rows alone: of equal payloads of at least ``least`` bytes the one
with the largest page id stays a response, the others become revisits of it.

Normalising.  A file is inflated once, as a stream; every record is written as a gzip member of its own, and its place and length go to a sidecar
index beside the file (``.idx``, JSON lines).  Revisits lose their payload here and keep its digest and size.  A record is never held whole.

Reading.  The index is dealt by ranges of (file, offset), so that a file has as many tasks as its size asks for; each record is found by
its offset, inflated alone, and its payload's digest compared with the one it was written with.

Files are written beside their name and moved to it when they are whole; a task that runs again writes the same bytes.  The folder is opened with
pyarrow.fs (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read, write_out

LEAST_BYTES = 1000
#: Bytes of records, before compression, after which a task begins a new file; bytes of archives that a reading task takes.
FILE_BYTES, READ_BYTES = 256 << 20, 4 << 20
CHUNK = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31  # zlib's window bits for gzip


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


class _Out:
    """A file that stands under its name once it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, at = _open(folder)
        context = TaskContext.get()
        self.name, self.to = name, f"{at}/{name}"
        self.now = f"{at}/_{context.taskAttemptId() if context else 0}-{name}"
        self.stream, self.at = self.fs.open_output_stream(self.now, compression=None), 0

    def write(self, raw: bytes) -> None:
        if raw:
            self.stream.write(raw)
            self.at += len(raw)

    def done(self) -> None:
        self.stream.close()
        if not isinstance(self.fs, pafs.LocalFileSystem) and self.fs.get_file_info(self.to).type == pafs.FileType.File:
            self.fs.delete_file(self.to)
        self.fs.move(self.now, self.to)


class Inflated:
    """Bytes of a gzip file of any number of members, from a stream of at most ``limit`` compressed bytes."""

    def __init__(self, raw, name: str, limit: int | None = None):
        self.raw, self.name, self.left = raw, name, limit
        self.held, self.at = b"", 0  # inflated, and what of it is taken
        self.zip, self.rest, self.over = None, b"", False

    def _more(self) -> bool:
        """Inflate a little more into held; false at the end."""
        while not self.over:
            if not self.rest:
                self.rest = self.raw.read(CHUNK if self.left is None else min(CHUNK, self.left))
                if self.left is not None:
                    self.left -= len(self.rest)
                if not self.rest:
                    if self.zip is not None:
                        raise ValueError(f"{self.name} ends inside a gzip member")
                    self.over = True
                    break
            self.zip = self.zip or zlib.decompressobj(_GZIP)
            try:
                got = self.zip.decompress(self.rest, CHUNK)
            except zlib.error as e:
                raise ValueError(f"{self.name} is no gzip stream: {e}") from None
            if self.zip.eof:
                self.rest, self.zip = self.zip.unused_data.lstrip(b"\0") if self.zip.unused_data[:1] == b"\0" else self.zip.unused_data, None
            else:
                self.rest = self.zip.unconsumed_tail
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True
        return False

    def line(self, most: int = 1 << 30) -> bytes:
        """The next line with its end, or what is left; at most so many bytes."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if seen >= most or not self._more():
                break
        cut = min(self.at + most, end + 1 if end >= 0 else len(self.held))
        out, self.at = self.held[self.at : cut], cut
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError(f"{self.name} ends inside a record")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def head_of(stream: Inflated) -> dict[str, str] | None:
    """The next record's named fields, names in small letters; None at the end."""
    while (first := stream.line()) and not first.strip():
        pass
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"{stream.name} has no record where one should begin: {first[:40]!r}")
    fields: dict[str, str] = {":version": first.decode("utf-8", "replace").strip()}
    last = None
    while (line := stream.line()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
    return fields


_NAMES = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Profile", "WARC-Refers-To", "Content-Type", "Content-Length", "Page-Id", "Refers-To-Page-Id")}


def head(fields: dict[str, str]) -> bytes:
    lines = [fields.get(":version", "WARC/1.1"), *(f"{_NAMES.get(k, k)}: {v}" for k, v in fields.items() if k[0] != ":")]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _plain(text: str, percent: bool) -> str:
    """Text on one line; reversible by unquote if percent signs are written so too."""
    if text.isprintable() and (not percent or "%" not in text):
        return text
    return "".join(c if c.isprintable() and (c != "%" or not percent) else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_id(file: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{nth}')}>"


def sha1_text(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def sha1_hex(field: str) -> str:
    """Hex digits of a field's SHA-1, which may stand in base 32 or base 16."""
    value = field.partition(":")[2] or field
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def response(file: str, nth: int, page_id, url: str | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"warc-type": "response", "warc-record-id": record_id(file, nth), "warc-date": DATE}
    fields |= {} if url is None else {"warc-target-uri": _plain(url, False)}
    fields |= {"warc-payload-digest": sha1_text(hashlib.sha1(payload).digest()), "content-type": "application/http;msgtype=response", "content-length": str(len(http) + len(payload))}
    fields |= {} if page_id is None else {"page-id": _plain(str(page_id), True)}
    return head(fields) + http + payload + b"\r\n\r\n"


# ---- writing ----


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write monolithic archives to path; (file, nth, page_id, payload_bytes, payload_digest) per record.

    A null payload is empty; a null url or id has no field; repeated rows are records of their own; no rows write no file.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    _folder(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, out, zipped, raw, nth = TaskContext.get().partitionId(), 0, None, None, 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                names, places, sizes, digests = [], [], [], []
                for page_id, url, html in zip(*some.columns, strict=True):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    if out is None:
                        out, zipped, raw, nth = _Out(path, f"part-{part:06d}-{files:03d}.warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP), 0, 0
                    record = response(out.name, nth, page_id.as_py(), url.as_py(), payload)
                    out.write(zipped.compress(record))
                    names.append(out.name)
                    places.append(nth)
                    sizes.append(len(payload))
                    digests.append(hashlib.sha1(payload).hexdigest())
                    raw, nth = raw + len(record), nth + 1
                    if raw >= file_bytes:
                        out.write(zipped.flush())
                        out.done()
                        out, files = None, files + 1
                if names:
                    yield pa.record_batch([pa.array(names), pa.array(places), some.column(0), pa.array(sizes, pa.int64()), pa.array(digests)], names=["file", "nth", "page_id", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(zipped.flush())
            out.done()

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return write_out(rows.mapInArrow(run, f"file string, nth long, page_id {kind}, payload_bytes long, payload_digest string"), "records")


def repeats(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(file, nth, refers_to, to_file, to_nth) of the records that are to be revisits.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id, null being the smallest, stays; of repeated
    rows the one that was written last.
    """
    large = records.where(F.col("payload_bytes") >= least)
    rank = F.struct("page_id", "file", "nth")
    kept = large.groupBy("payload_digest").agg(F.max(rank).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = large.join(kept, "payload_digest").where((F.col("file") != F.col("kept.file")) | (F.col("nth") != F.col("kept.nth")))
    return found.select("file", "nth", F.col("kept.page_id").cast("string").alias("refers_to"), F.col("kept.file").alias("to_file"), F.col("kept.nth").alias("to_nth"))


# ---- normalising ----


def normalise_file(source, name: str, out: _Out, revisits: Iterator[tuple[int, str | None, str, int]]) -> Iterator[dict]:
    """Rewrite a stream's records as members of out; an index entry for each.  revisits: (number, id, file, number of the response), in order."""
    stream, todo = Inflated(source, name), next(revisits, None)
    for nth in itertools.count():
        fields = head_of(stream)
        if fields is None:
            if todo is not None:
                raise ValueError(f"{name} has no record {todo[0]}")
            return
        size, block = int(fields["content-length"]), None
        if todo is not None and todo[0] == nth:
            block, left = b"", size
            while left and not block.endswith(b"\r\n\r\n"):  # the HTTP head alone
                if not (piece := stream.line(left)):
                    raise ValueError(f"{name} ends inside a record")
                block, left = block + piece, left - len(piece)
            for _ in stream.take(left):
                pass
            fields |= {"warc-type": "revisit", "warc-profile": PROFILE, "warc-refers-to": record_id(todo[2], todo[3]), "content-length": str(len(block))}
            fields |= {} if todo[1] is None else {"refers-to-page-id": _plain(todo[1], True)}
            todo = next(revisits, None)
        start, member = out.at, zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
        out.write(member.compress(head(fields)))
        for piece in stream.take(size) if block is None else [block]:
            out.write(member.compress(piece))
        out.write(member.compress(b"\r\n\r\n") + member.flush())
        yield {"file": out.name, "offset": start, "length": out.at - start, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}


INDEX = "file string, offset long, length long, type string, uri string, digest string"


def normalise(spark: SparkSession, source: str, path: str, revisits: DataFrame | None = None) -> None:
    """Rewrite the .warc.gz files of source, each a stream of any members, to path with a member a record and an .idx beside each.

    A file is one task, since a stream can be inflated from its start only.  revisits: as repeats() returns them.
    """
    _folder(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    none = F.lit(None)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source).select(name.alias("file"), F.lit(-1).cast("long").alias("nth"), none.cast("string").alias("refers_to"), none.cast("string").alias("to_file"), none.cast("long").alias("to_nth"))
    files = write_out(files, "files")
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        fs, at = _open(source)
        for file, group in itertools.groupby(rows, key=lambda r: r[0]):
            next(group)  # the row of the file itself
            out, index = _Out(path, file), _Out(path, file + ".idx")
            with fs.open_input_stream(f"{at}/{file}", compression=None) as raw:
                count = 0
                for count, entry in enumerate(normalise_file(raw, file, out, (r[1:] for r in group)), 1):  # noqa: B007
                    index.write((json.dumps(entry) + "\n").encode())
            out.done()
            index.done()
            yield pa.record_batch([pa.array([file]), pa.array([count], pa.int64())], names=["file", "n"])

    rows = files if revisits is None else files.unionByName(revisits)
    # the number of tasks is given, as the rows say nothing of the files' sizes
    dealt = rows.repartitionByRange(n, "file").sortWithinPartitions("file", "nth")
    write_out(dealt.mapInArrow(run, "file string, n long"), "normalised")


# ---- reading ----


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(path)


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None, payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """(file, offset, record_type, url, page_id, refers_to, payload_bytes, payload_digest[, payload]) per record of the index, or of part of it.

    Size and digest are of the full payload: a response's are worked out from what is read (another digest than the one it was written with
    raises), a revisit's are those of its fields.
    """
    index = read_index(spark, path) if index is None else index
    total = index.agg(F.sum("length")).first()[0] or 0
    schema = "file string, offset long, record_type string, url string, page_id string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def one(raw, file: str, offset: int, length: int) -> tuple:
        raw.seek(offset)
        stream = Inflated(raw, file, length)
        fields = head_of(stream)
        left = int(fields["content-length"])
        http: dict[str, str] = {}
        while left:
            line = stream.line(left)
            left -= len(line)
            if not line.strip():
                break
            key, _, value = line.decode("utf-8", "replace").partition(":")
            http[key.lower()] = value.strip()
        sha, size, held, given = hashlib.sha1(), 0, [], sha1_hex(fields.get("warc-payload-digest", "sha1:"))
        for piece in stream.take(left):
            sha.update(piece)
            size += len(piece)
            if payload:
                held.append(piece)
        if fields["warc-type"] == "revisit":
            size, digest = int(http["content-length"]), given
        else:
            digest = sha.hexdigest()
            if given and given != digest:
                raise ValueError(f"{file} at {offset}: the payload is not what was written")
        ids = [None if (x := fields.get(k)) is None else unquote(x) for k in ("page-id", "refers-to-page-id")]
        return (file, offset, fields["warc-type"], fields.get("warc-target-uri"), *ids, size, digest, *([b"".join(held)] if payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        name, raw = None, None
        for b in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if raw is not None:
                        raw.close()
                    name, raw = file, fs.open_input_file(f"{at}/{file}")
                rows.append(one(raw, file, offset, length))
                held += rows[-1][6] if payload else 0
                if held > 16 << 20 or len(rows) >= 10_000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if raw is not None:
            raw.close()

    text, whole = pa.string(), pa.int64()
    types = [text, whole, text, text, text, text, whole, text, pa.binary()][: len(names)]
    dealt = index.select("file", "offset", "length").repartitionByRange(1 + total // read_bytes, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str, least: int = LEAST_BYTES, **options) -> None:
    """Write pages' archives to path, a member a record, repeated payloads as revisits, an index beside each file."""
    spark, raw = pages.sparkSession, new_path(pages.sparkSession, "streams")
    records = write_archives(pages, raw, **options)
    normalise(spark, raw, path, repeats(records, least))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive(read(spark, sf_dir, "pages"), path)
    found = read_records(spark, path, payload=False)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = {
    "op11_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS sha FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS kept, row_number() OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST) AS nth FROM d)
SELECT page_id, n AS payload_bytes, sha AS payload_digest, CASE WHEN n < {LEAST_BYTES} OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < {LEAST_BYTES} OR nth = 1 THEN NULL ELSE kept END AS refers_to
FROM k
"""
}
