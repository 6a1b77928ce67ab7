"""Best-fit packing of token sequences by best-two-fit on a length histogram.

Which documents have a length is irrelevant to a packing; only how many have.
The plan is therefore made on the histogram of piece lengths, which has at
most ``capacity`` entries whatever the corpus, and each filled bin is repeated
as long as the counts allow.  Pieces then find their places by their rank
among pieces of equal length: a prefix sum over partitions, never a global sort.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manifolder.llm.encoder import encoder
from manifolder.llm.runtime import Workspace


def cut_lengths(n_tokens: int, capacity: int) -> list[int]:
    """Piece lengths of a document: only longer ones are cut, the first piece is the shorter one."""
    if n_tokens <= capacity:
        return [n_tokens]
    head = n_tokens % capacity
    return [head] * (head > 0) + [capacity] * (n_tokens // capacity)


def _best_two(lengths: list[int], counts: Counter, room: int, above: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum in (above, room]."""
    best, found, i, j = above, None, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room:
            j -= 1
            continue
        if total > best and (i != j or counts[lengths[i]] >= 2):
            best, found = total, (lengths[j], lengths[i])
            if total == room:
                break
        i += 1
    return found


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, how many such bins) by best-two-fit.

    A bin is filled greedily, largest first; then its smallest member gives
    way to two unpacked ones that fit the gap it leaves more tightly, if any.
    """
    counts = Counter({k: v for k, v in histogram.items() if v > 0})
    lengths = sorted(counts)
    plan: list[tuple[list[int], int]] = []
    while lengths:
        room, filled, used = capacity, [], Counter()
        at = len(lengths)
        while at:
            at = bisect_right(lengths, room, 0, at)
            if not at:
                break
            size = lengths[at - 1]
            take = min(room // size, counts[size])
            filled += [size] * take
            used[size] += take
            room -= size * take
            at -= 1
        smallest = filled[-1]
        if len(filled) > 1 and room:
            left = counts.copy()
            left.subtract(used)
            left[smallest] += 1
            two = _best_two([x for x in lengths if left[x] > 0], left, room + smallest, smallest)
            if two:
                filled = sorted([*filled[:-1], *two], reverse=True)
                used = Counter(filled)
        times = min(counts[x] // n for x, n in used.items())
        if len(filled) > 1 and times > 1:  # the member given way has to be there each time
            times = max(1, min([times, *((counts[x] - 1) // n for x, n in used.items() if x == smallest)]))
        plan.append((filled, times))
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
                lengths.remove(x)
    return plan


def place_runs(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a bin, offset in the bin)."""
    runs: dict[int, list] = {}
    ranks: Counter = Counter()
    sequence = 0
    for filled, times in plan:
        offset = 0
        for size in sorted(set(filled), reverse=True):
            copies = filled.count(size)
            runs.setdefault(size, []).append((ranks[size], sequence, copies, offset))
            ranks[size] += copies * times
            offset += copies * size
        sequence += times
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, part, nth) for each piece of each document.

    ids are little-endian unsigned 32-bit.  part is the task and nth the
    number of pieces of that length which the task made before.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode_texts
        end = np.array([end_id], "<u4").tobytes()
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids, rows = some.column(0).to_pylist(), []
                for k, data in enumerate(encode(some.column(1))):
                    data += end
                    start = 0
                    for piece, size in enumerate(cut_lengths(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + size)]
                        rows.append((ids[k], piece, start, size, own, zlib.crc32(own), part, seen[size]))
                        seen[size] += 1
                        start += size
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset) for each piece.

    The ids stay in a table of the workspace, and a query that leaves them out
    doesn't move them to place the pieces.  Sequences hold at most ``capacity`` tokens; offsets in one are gapless
    from 0.  A null or empty text is its end id alone.  Rows that repeat an id
    are packed each on their own; an empty table packs nothing.  The driver
    holds the plan: a few rows for each of ``capacity`` lengths.
    """
    ws = Workspace(spark, "pack")
    pieces = ws.table(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").count()
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = place_runs(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length, rank):
        import pandas as pd

        size, nth = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for value in np.unique(size):
            at = np.flatnonzero(size == value)
            table = runs[int(value)]
            row = table[np.searchsorted(table[:, 0], nth[at], side="right") - 1]
            step = nth[at] - row[:, 0]
            sequence[at] = row[:, 1] + step // row[:, 2]
            offset[at] = row[:, 3] + step % row[:, 2] * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")
