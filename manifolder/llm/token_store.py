"""Token ids on disk: documents compressed one by one with a shared dictionary.

A store is a folder with ``dictionary`` and shards.  A shard is

    magic | frame of document 0 | frame of document 1 | ... | index | footer

where a frame is one Zstandard frame of the document's ids (unsigned 16-bit
if the vocabulary allows, else 32-bit, little-endian), the index has for each
document its id, whether it has one, where its frame ends and how many ids it
has, and the footer has the place of the index, the number of documents, the
width of an id and the hash of the dictionary.  Shards are in ascending order
of document ids, and so are the documents in one; a short document is read
with two seeks and one small decompression.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifolder.llm import zdict
from manifolder.llm.encoder import encoder
from manifolder.llm.runtime import Workspace, column, open_fs, parts_for

_MAGIC = b"MFTOKEN1"
_FOOTER = struct.Struct("<QQQQ8s")


def _train(rows: DataFrame, total: int, tokenizer: str, width: int, sample_docs: int) -> bytes:
    def serialized(batch):
        for data in encoder(tokenizer).encode_texts(batch.column(1)):
            yield np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes()

    return zdict.train(zdict.sample(rows, total, serialized, sample_docs))


def _footer(at: int, docs: int, width: int, dictionary: bytes) -> bytes:
    return _FOOTER.pack(at, docs, width, zdict.digest(dictionary), _MAGIC)


def _writer(uri: str, tokenizer: str, end_id: int, width: int, dictionary: bytes, level: int):
    def run(batches):
        from pyspark import TaskContext

        fs, root = open_fs(uri)
        part = TaskContext.get().partitionId()
        path = f"{root}/shard-{part:06d}-{uuid.uuid4().hex[:8]}"
        encode = encoder(tokenizer).encode_texts
        pack = zdict.compressor(dictionary, level)
        end = np.array([end_id], "<u4").tobytes()
        keys, has, ends, sizes, at, out = [], [], [], [], len(_MAGIC), None
        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(path)
                out.write(_MAGIC)
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                keys += [x or 0 for x in some.column(0).to_pylist()]
                has += some.column(0).is_valid().to_pylist()
                for data in encode(some.column(1)):
                    ids = np.frombuffer(data + end, "<u4")
                    frame = pack.compress(ids.astype(f"<u{width}").tobytes())
                    out.write(frame)
                    at += len(frame)
                    ends.append(at)
                    sizes.append(len(ids))
        if out is not None:
            with out:
                for values, kind in ((keys, "<i8"), (has, "u1"), (ends, "<u8"), (sizes, "<u8")):
                    out.write(np.array(values, kind).tobytes())
                out.write(_footer(at, len(keys), width, dictionary))
            row = ([part], [path], [len(keys)], [int(sum(sizes))])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "docs", "tokens"])

    return run


class Shard:
    """Random and sequential access to one shard."""

    def __init__(self, fs, path: str, dictionary: bytes):
        self._file = fs.open_input_file(path)
        size = self._file.size()
        at, n, width, hashed, magic = _FOOTER.unpack(self._file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC or hashed != zdict.digest(dictionary):
            raise ValueError(f"{path} is no token shard of this dictionary")
        index = self._file.read_at(size - _FOOTER.size - at, at)
        self.ids = np.frombuffer(index, "<i8", n)
        self.has_id = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.ends = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.sizes = np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
        self.starts = np.concatenate([[len(_MAGIC)], self.ends[:-1]])
        self._unpack, self._kind = zdict.decompressor(dictionary), f"<u{width}"

    def document(self, k: int) -> np.ndarray:
        """The ids of document ``k``, as unsigned 32-bit integers."""
        return self.decode(self._file.read_at(int(self.ends[k] - self.starts[k]), int(self.starts[k])))

    def decode(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self._unpack.decompress(frame), self._kind).astype("<u4")

    def documents(self, most: int = 8_000_000):
        """All documents in order, read in stretches of about ``most`` bytes."""
        k = 0
        while k < len(self.ends):
            stop = max(k + 1, int(np.searchsorted(self.ends, self.starts[k] + most, side="right")))
            base = int(self.starts[k])
            data = self._file.read_at(int(self.ends[stop - 1]) - base, base)
            for j in range(k, stop):
                yield self.decode(data[self.starts[j] - base : self.ends[j] - base])
            k = stop


def read_dictionary(uri: str) -> bytes:
    fs, root = open_fs(uri)
    with fs.open_input_file(f"{root}/dictionary") as f:
        return f.read()


def read_document(uri: str, path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document of a shard, or None if it isn't there."""
    shard = Shard(open_fs(uri)[0], path, read_dictionary(uri))
    k = int(np.searchsorted(shard.ids[shard.has_id], doc_id))
    return shard.document(k) if k < shard.has_id.sum() and shard.ids[k] == doc_id else None


def write_store(spark: SparkSession, docs: DataFrame, uri: str, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257, sample_docs: int = 2000, level: int = 3, shard_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all of ``docs`` to ``uri``; returns the manifest (part, path, docs, tokens), a row for each shard.

    Null and empty texts are their end id alone.  Ids must be whole numbers;
    null ids come last, and rows that repeat an id are all written, in order
    of a hash of their texts.  A shard has about ``shard_bytes`` of text,
    however many rows share an id or a text; a longer text is one shard's.
    An empty table makes no shard; other columns are not read.  The dictionary
    is trained on about ``sample_docs`` documents.
    """
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    dictionary = _train(rows, total, tokenizer, width, sample_docs)
    fs, root = open_fs(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("row")]
    placed = rows.select("id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = placed.repartitionByRange(parts_for(size, shard_bytes), *order).sortWithinPartitions(*order).select("id", "text")
    written = dealt.mapInArrow(_writer(uri, tokenizer, end_id, width, dictionary, level), "part int, path string, docs long, tokens long")
    return spark.createDataFrame(sorted(written.collect()) or [], written.schema)


def read_store(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) for each document, read back from the shards.

    start counts the ids of all documents before; ids are little-endian
    unsigned 32-bit.  The manifest, a row for each shard, is all the driver holds.
    """
    shards, before = [], 0
    for row in manifest.orderBy("part").collect():
        shards.append((row.path, before))
        before += row.tokens

    def run(batches):
        fs, _ = open_fs(uri)
        dictionary = read_dictionary(uri)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(fs, path, dictionary)
                starts = start + np.cumsum(shard.sizes) - shard.sizes
                held, at = [], 0
                for ids in shard.documents():
                    held.append(ids.tobytes())
                    if len(held) == 1024 or at + len(held) == len(starts):
                        to = slice(at, at + len(held))
                        yield pa.RecordBatch.from_arrays([pa.array(shard.ids[to], mask=~shard.has_id[to]), pa.array(starts[to]), pa.array(shard.sizes[to]), pa.array(held, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        at += len(held)
                        held = []

    listed = spark.createDataFrame(shards, "path string, start long").repartition(max(1, len(shards)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def stored_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a store of this session and read it back."""
    ws = Workspace(spark, "tokens")
    return read_store(spark, ws.uri, write_store(spark, docs, ws.uri, tokenizer, **options))
