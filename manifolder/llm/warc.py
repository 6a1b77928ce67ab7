"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive is one ``.warc.zst`` file: a skippable frame with the dictionary,
itself compressed, then one Zstandard frame for each record.  The dictionary
comes from records that are about to be archived.  Records whose payload
another record has are revisits without a payload, which name the record that
has it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifolder.llm import zdict
from manifolder.llm.runtime import Workspace, open_fs

#: Fixed values of the formats.
_SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.NAMESPACE_URL


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def make_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """A response record with its payload, or a revisit record that has its HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        headers += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}"]
    headers += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        headers.append(f"WARC-Page: {page_id}")
    headers.append(f"Content-Length: {len(block)}")
    return "\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers by lower-case name, HTTP head and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def split_archive(file):
    """The records of an open archive, one by one; reads it in stretches and needs no index."""
    kind, size = struct.unpack("<II", file.read(8))
    if kind != _SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=1 << 26)
    unpack = zdict.decompressor(dictionary)
    data, record, frame = b"", [], unpack.decompressobj()
    while True:
        if not data:
            data = file.read(1 << 20)
            if not data:
                break
        record.append(frame.decompress(data))
        data = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(record)
            record, frame = [], unpack.decompressobj()
    if any(record):
        raise ValueError("the archive ends within a record")


def _digests(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))


def duplicate_pages(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, sha1, first): the smallest page with the same payload, where that is another page.

    A payload of a third of all pages is one row for each task before the
    shuffle, and its pages meet the single row of its first page by a join
    that Spark can split.
    """
    digests = _digests(pages, id_col, html_col)
    firsts = digests.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return digests.join(firsts, ["sha1", "bytes"]).where("not (page_id <=> first)").select("page_id", "sha1", "first").distinct()


def _train(rows: DataFrame, sample_records: int) -> bytes:
    def serialized(batch):
        for r in batch.to_pylist():
            yield make_record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"))

    return zdict.train(zdict.sample(rows, rows.count(), serialized, sample_records))


def _writer(uri: str, dictionary: bytes, level: int):
    def run(batches):
        from pyspark import TaskContext

        fs, root = open_fs(uri)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.zst"
        pack, out, n = zdict.compressor(dictionary, level), None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(path, compression=None)
                out.write(dictionary_frame(dictionary))
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    record = make_record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["first"], r["revisit"])
                    out.write(pack.compress(record))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def write_archives(spark: SparkSession, pages: DataFrame, uri: str, least_bytes: int = 0, sample_records: int = 1000, level: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of ``pages`` to archives in ``uri``; returns (path, records).

    The payload is the html in UTF-8, of null html the empty one.  Of pages
    with equal payloads of at least ``least_bytes`` that of the smallest id is
    the response, as are rows that repeat its id; a null id comes after all
    others.  The dictionary is trained on about ``sample_records``
    records.  An empty table makes no archive; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    dictionary = _train(rows, sample_records)
    fs, root = open_fs(uri)
    fs.create_dir(root, recursive=True)
    again = duplicate_pages(rows, least_bytes, "page_id", "html").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "first")
    keyed = rows.withColumn("sha1", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    joined = keyed.join(again, keyed["page_id"].eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    marked = joined.select("page_id", "url", "html", "first", F.col("_sha1").isNotNull().alias("revisit"))
    written = marked.mapInArrow(_writer(uri, dictionary, level), "path string, records long")
    return spark.createDataFrame(sorted(written.collect()) or [], written.schema)


def read_archives(spark: SparkSession, uri: str, archives: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of every record.

    Size and digest are those of the full payload: computed from what is read
    for responses, and as the record's headers give them for revisits, whose
    html is null.
    """

    def run(batches):
        fs, _ = open_fs(uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for data in split_archive(f):
                        rows.append(_row(data))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, archives.count())
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string"
    found = archives.select("path").repartition(n).mapInArrow(run, schema)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def _row(data: bytes) -> tuple:
    fields, http, payload = parse_record(data)
    revisit = fields["warc-type"] == "revisit"
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != stated:
        raise ValueError(f"the payload of page {fields.get('warc-page')} doesn't have the digest it was written with")
    size = int(http.decode().lower().split("content-length: ")[1].split("\r\n")[0]) if revisit else len(payload)
    return (fields.get("warc-page"), fields.get("warc-target-uri"), size, stated, fields["warc-type"], fields.get("warc-refers-to-page"), None if revisit else payload.decode("utf-8", "surrogatepass"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def archived_pages(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives of this session and read them back."""
    ws = Workspace(spark, "warc")
    return read_archives(spark, ws.uri, write_archives(spark, pages, ws.uri, **options), pages.schema[options.get("id_col", "page_id")].dataType.simpleString())
