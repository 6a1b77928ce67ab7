"""Shared Zstandard dictionaries: training on a bounded sample, and codecs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of samples a dictionary is trained on, at most; the data compressed with it are not bounded.
SAMPLE_BYTES = 16_000_000

_PIECE = 4096


def sample(rows: DataFrame, total: int, serialized: Callable[[pa.RecordBatch], Iterable[bytes]], sample_rows: int) -> list[bytes]:
    """Pieces of about ``sample_rows`` of the ``total`` rows, chosen by hash, ``SAMPLE_BYTES`` at most.

    Executors serialize the chosen rows whole and cut them up; of more pieces
    than the bound allows those of the smallest hashes are taken, wherever in
    a row they lie.  Nothing but these pieces leaves a task.
    """

    def run(batches):
        for batch in batches:
            for data in serialized(batch):
                pieces = [data[at : at + _PIECE] for at in range(0, len(data), _PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], names=["piece"])

    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 62))
    chosen = rows.where(place < int((1 << 62) * min(1.0, sample_rows / max(1, total))))
    pieces = chosen.mapInArrow(run, "piece binary").orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_BYTES // _PIECE)
    return pieces.toArrow().column(0).to_pylist()


def train(pieces: list[bytes], size: int = 65_536) -> bytes:
    """A dictionary of about ``size`` bytes.

    Too few samples for training give the samples themselves as raw content;
    none give an empty dictionary.
    """
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def digest(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary)


def _data(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if len(dictionary) >= 8 else {}


def compressor(dictionary: bytes, level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=True, **_data(dictionary))


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(**_data(dictionary))
