"""Stupid-backoff scores of documents under n-gram counts of their own corpus.

Relations, all of them DataFrames:

* ``batches``: documents in batches of bounded size, compressed, dealt once.
* ``grams``: the exploded n-grams, a row for each batch and hash partition in
  which it has any.  N-grams go out by their context: a row lists the distinct
  contexts of n - 1 words, how often the batch has each, and the words that
  follow them, how often each.  So a frequent n-gram is one entry for each
  batch, not one for each occurrence, and a row never holds less than one
  n-gram: work and messages grow with the n-grams of the corpus.
* ``tables``: the count tables, partitioned by the hash of the context, and
  for each row of ``grams`` the counts of its entries in their order.  One
  partition has both the count of an n-gram and that of its context.
* Counts are joined to their batches, each word takes the counts of the
  n-grams that end at it, and its cost is summed for each document.

A context is told apart by 80 bits of hash and a word after it by another 47,
so a whole n-gram by 127.  Of m distinct contexts about m * m / 2 ** 81 pairs
would share counts: none is to be expected among 10 ** 11.  The most frequent
words of a sample have short codes instead of hashes; that makes rows smaller
and changes no count.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from manifolder.llm.runtime import WORD, column, parts_for

#: Text bytes in a batch of documents, and in what a hash partition of n-grams comes from.
_BATCH_BYTES = 8_000_000
_PARTITION_BYTES = 8_000_000

_HEAD = struct.Struct("<QQ")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return text.lower().split()


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of an n-gram from that of its first words and of its last word."""
    x = a * np.uint64(salt) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct pair, group of each place), groups in ascending order.

    Sorted by ``high`` alone, unless equal ones turn out to differ in ``low``.
    """
    order = np.argsort(high, kind="stable")
    high_sorted, low_sorted = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = high_sorted[1:] != high_sorted[:-1]
    if (~new[1:] & (low_sorted[1:] != low_sorted[:-1])).any():
        order = np.lexsort((low, high))
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    group = np.empty(len(high), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def grouped_words(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the number of a context, below 2 ** 32, and a word: by 32 bits of the word, then by all."""
    return grouped(context.astype(np.uint64) << np.uint64(32) | word & np.uint64(0xFFFFFFFF), word)


def kinds(order: int) -> list[tuple[int, bool]]:
    """(words of the context, whether the word after it counts, too): what covers all n-grams up to ``order``."""
    out = [(n, True) for n in range(order - 1, 0, -2)]
    return out if order % 2 == 0 else [*out, (1, False)]


class Batch:
    """Words of a batch of documents as hashes, and its n-grams by kind."""

    def __init__(self, texts: list[bytes], codes: dict[bytes, int]):
        index, sizes, places = {}, [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            places.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
        self.sizes = np.array(sizes, np.int64)
        n, at = int(self.sizes.sum()), np.concatenate([*places, np.zeros(0, np.int32)])
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, index)), ">u8").reshape(-1, 2).astype(np.uint64)
        coded = np.fromiter((codes.get(w, -1) for w in index), np.int64, len(index))
        words = np.where(coded >= 0, coded.astype(np.uint64), digests[:, 1] >> np.uint64(17) | np.uint64(1 << 47))
        self.high, self.low, self.word = digests[at, 0], digests[at, 1], words[at]
        self.place = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)  # in its document
        self.hashes = {1: (self.high, self.low)}

    def gram(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams by the place of the last word."""
        if n not in self.hashes:
            high, low = self.gram(n - 1)
            shifted = [np.concatenate([x[:1], x[:-1]]) for x in (high, low)]
            self.hashes[n] = (_mix(shifted[0], self.high, 0x9E3779B97F4A7C15), _mix(shifted[1], self.low, 0xD6E8FEB86659FD93))
        return self.hashes[n]

    def entries(self, n: int, follow: bool) -> dict:
        """Distinct contexts of ``n`` words, ascending, and the distinct words after each, ascending in it.

        ``at`` and ``context`` have the place of each context's last word and
        the context there; ``next_at`` and ``following`` those of each word
        that follows one and its entry.
        """
        at = np.flatnonzero(self.place >= n - 1)
        high, low = (x[at] for x in self.gram(n))
        low = low & np.uint64(0xFFFF)
        first, context = grouped(high, low)
        out = {"at": at, "context": context, "high": high[first], "low": low[first], "times": np.bincount(context, minlength=len(first))}
        inside = np.flatnonzero(at + 1 < len(self.place)) if follow else at[:0]
        inside = inside[self.place[at[inside] + 1] > 0]  # the next word is of the same document
        out["next_at"] = at[inside] + 1
        word = self.word[out["next_at"]]
        first, out["following"] = grouped_words(context[inside], word)
        out["words"], out["of"] = word[first], context[inside][first]
        out["word_times"] = np.bincount(out["following"], minlength=len(first))
        return out


def _planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of whole numbers, the first bytes of all, then the second, and so on."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


#: Of a packed row: steps of the sorted hashes, their other bits, times; words after each, their hashes and times.
_WIDTHS = ((8, 2, 5, 5), (6, 5))


def pack(high, low, times, follow, words, word_times) -> bytes:
    data = [_HEAD.pack(len(high), len(words))]
    steps = np.diff(high, prepend=np.uint64(0))
    data += [_planes(v, w) for v, w in zip((steps, low, times, follow, words, word_times), (*_WIDTHS[0], *_WIDTHS[1]))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(data))


def unpack(data: bytes) -> list[np.ndarray]:
    """What was packed: hashes, other bits, times, words after each; hashes and times of the words."""
    data, out = zstandard.ZstdDecompressor().decompress(data), []
    at = _HEAD.size
    for n, widths in zip(_HEAD.unpack_from(data), _WIDTHS):
        for width in widths:
            out.append(_values(data, at, n, width))
            at += n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _pack_counts(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(values, 8))


def _unpack_counts(data: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    return _values(data, 0, len(data) // 8, 8).astype(np.int64)


def _part(high: np.ndarray, parts: int) -> np.ndarray:
    """Ascending hash ranges: the partition of each hash."""
    return ((high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _ranges(e: dict, parts: int):
    """(partition, first context, end, first word, end) of each partition that has any of the entries."""
    part = _part(e["high"], parts)
    names, starts = np.unique(part, return_index=True)
    ends = np.append(starts, len(part))[1:]
    words = np.searchsorted(e["of"], [starts, ends])
    yield from zip(names.tolist(), starts.tolist(), ends.tolist(), *words.tolist())


def _batched(id_type: pa.DataType):
    """Documents as rows (batch, ids, sizes, texts) of about ``_BATCH_BYTES`` of text, compressed."""

    def run(batches):
        first, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def row():
            sizes = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([ids], pa.list_(id_type)), sizes, pa.array([packed], pa.binary())], names=["batch", "ids", "sizes", "texts"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                ids.append(key.as_py())
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + 64
                if held >= _BATCH_BYTES:
                    yield row()
                    ids, texts, held, n = [], [], 0, n + 1
        if ids:
            yield row()

    return run


def _texts(sizes: list[int], packed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(sizes).tolist()
    return [data[e - n : e] for e, n in zip(ends, sizes)]


def _counted_words(batches):
    for batch in batches:
        seen = Counter(w for text in batch.column(0).to_pylist() for w in words_of((text or "").encode("utf-8", "surrogatepass")) if len(w) <= 64)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


def frequent_words(rows: DataFrame, total: int, sample_docs: int = 4000, most: int = 1 << 16) -> dict[bytes, int]:
    """A code for each of the ``most`` most frequent words, of 64 bytes at most, of about ``sample_docs`` documents."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 62))
    chosen = rows.where(place < int((1 << 62) * min(1.0, sample_docs / max(1, total)))).select("text")
    counts = chosen.mapInArrow(_counted_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column(0).to_pylist()
    return {w: k for k, w in enumerate(found)}


_GRAMS = "part long, kind int, batch long, entries binary"
_COUNTS = "batch long, kind int, part long, counts binary"


def _exploded(order: int, parts: int, codes: Broadcast):
    """The n-grams of each batch: a row for each kind and hash partition that has any."""

    def run(batches):
        for some in batches:
            for r in some.to_pylist():
                batch = Batch(_texts(r["sizes"], r["texts"]), codes.value)
                for kind, (n, follow) in enumerate(kinds(order)):
                    e = batch.entries(n, follow)
                    each = np.bincount(e["of"], minlength=len(e["high"]))
                    names, rows = [], []
                    for part, a, b, c, d in _ranges(e, parts):
                        names.append(part)
                        rows.append(pack(e["high"][a:b], e["low"][a:b], e["times"][a:b], each[a:b], e["words"][c:d], e["word_times"][c:d]))
                    same = [np.full(len(names), kind, np.int32), np.full(len(names), r["batch"], np.int64)]
                    arrays = [pa.array(names, pa.int64()), *map(pa.array, same), pa.array(rows, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "batch", "entries"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """The count table of one hash partition, as the counts of each batch's entries."""
    rows = [unpack(x.as_py()) for x in table.column("entries")]
    high, low, times, follow, words, word_times = (np.concatenate(c) for c in zip(*rows))
    first, context = grouped(high, low)
    totals = np.bincount(context, times.astype(np.float64), len(first)).astype(np.int64)[context]
    of = np.repeat(context, follow.astype(np.int64))
    first, following = grouped_words(of, words)
    word_totals = np.bincount(following, word_times.astype(np.float64), len(first)).astype(np.int64)[following]
    a, b, out = 0, 0, []
    for r in rows:
        out.append(_pack_counts(np.concatenate([totals[a : a + len(r[0])], word_totals[b : b + len(r[4])]])))
        a, b = a + len(r[0]), b + len(r[4])
    columns = [table.column("batch"), table.column("kind"), table.column("part"), pa.array(out, pa.binary())]
    return pa.Table.from_arrays(columns, names=["batch", "kind", "part", "counts"])


def _found(batch: Batch, answers: list[dict], order: int, parts: int) -> list[np.ndarray]:
    """Counts by order for the n-gram that ends at each word; 0 if unseen, -1 if it would start before the document."""
    found = [np.where(batch.place >= n, 0, -1) for n in range(order)]
    by_part = {(x["kind"], x["part"]): x["counts"] for x in answers}
    for kind, (n, follow) in enumerate(kinds(order)):
        e = batch.entries(n, follow)
        totals, word_totals = np.zeros(len(e["high"]), np.int64), np.zeros(len(e["words"]), np.int64)
        for part, a, b, c, d in _ranges(e, parts):
            counts = _unpack_counts(by_part[kind, part])
            totals[a:b], word_totals[c:d] = counts[: b - a], counts[b - a :]
        found[n - 1][e["at"]] = totals[e["context"]]
        if follow:
            found[n][e["next_at"]] = word_totals[e["following"]]
    return found


def backoff_micronats(found: list[np.ndarray], words: int, discount: float) -> np.ndarray:
    """-1e6 * ln S for each word, in whole numbers, from counts by order.

    ``found[n]`` has the counts of the (n + 1)-gram that ends at each word; 0
    if it was not seen, -1 if it would start before the document.
    """
    n_words = len(found[0])
    score, done = np.zeros(n_words), np.zeros(n_words, bool)
    for n in range(len(found) - 1, 0, -1):
        exists = found[n] >= 0
        context = np.concatenate([[0], found[n - 1][:-1]]) if n_words else found[n - 1]
        hit = ~done & exists & (found[n] > 0)
        score[hit] += np.log(found[n][hit] / context[hit])
        score[~done & exists & ~hit] += np.log(discount)
        done |= hit
    rest = ~done
    score[rest] += np.log(found[0][rest] / words)
    return -np.floor(score * 1e6 + 0.5).astype(np.int64)


_COSTS = "batch long, nth long, doc_id {}, n_words long, cost_micronats long"


def _scored(order: int, parts: int, codes: Broadcast, discount: float, least: int, words: int, id_type: pa.DataType):
    """A row for each document of a batch joined to its counts, and more for words whose longest seen n-gram is longer than one."""

    def run(batches):
        for some in batches:
            for r in some.to_pylist():
                batch = Batch(_texts(r["sizes"], r["texts"]), codes.value)
                found = _found(batch, r["answers"] or [], order, parts)
                used = np.zeros(len(batch.place), np.int64)
                for n, counts in enumerate(found[1:], 1):
                    counts[(counts > 0) & (counts < least)] = 0
                    used[counts > 0] = n
                cost, of = backoff_micronats(found, words, discount), np.repeat(np.arange(len(batch.sizes)), batch.sizes)
                for n in range(order):
                    own = used == n
                    sizes = np.bincount(of[own], minlength=len(batch.sizes))
                    totals = np.bincount(of[own], cost[own].astype(np.float64), len(batch.sizes)).astype(np.int64)  # whole, below 2 ** 53
                    some_docs = np.flatnonzero(sizes) if n else np.arange(len(sizes))
                    ids = pa.array([r["ids"][k] for k in some_docs], id_type)
                    columns = [np.full(len(some_docs), r["batch"]), some_docs, ids, sizes[some_docs], totals[some_docs]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["batch", "nth", "doc_id", "n_words", "cost_micronats"])

    return run


def stupid_backoff(spark: SparkSession, docs: DataFrame, order: int = 3, discount: float = 0.4, min_count: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, cost_micronats, cost_per_word) for every row of ``docs``.

    cost_micronats is the sum over the words of a whole text of
    round(-1e6 * ln S): S is count(n-gram) / count(context) for the longest
    n-gram up to ``order`` within the document with at least ``min_count``
    occurrences in the corpus, times ``discount`` for each order backed off
    from; a single word has count / words of the corpus, and every count is
    over all documents.  cost_per_word is its whole-number quotient by
    n_words, null without words.  Null and empty texts have no words and cost
    0.  Rows that repeat an id, or have none, are scored each on their own,
    and repeated texts count as often as they occur.  An empty table gives an
    empty result; other columns are not read.
    """
    text = column(text_col).cast("string")
    total, size, words = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.coalesce(F.sum(F.regexp_count(text, F.lit(WORD))), F.lit(0))).first()
    rows = docs.select(column(id_col).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType
    id_type, parts = to_arrow_type(kind), parts_for(size, _PARTITION_BYTES)
    codes = spark.sparkContext.broadcast(frequent_words(rows, total))  # 65,536 words of 64 bytes at most
    packed = rows.mapInArrow(_batched(id_type), f"batch long, ids array<{kind.simpleString()}>, sizes array<long>, texts binary")
    dealt = parts_for(size, 2 * _BATCH_BYTES)
    batches = packed.repartition(dealt, "batch")  # both uses below read the same shuffle
    grams = batches.mapInArrow(_exploded(order, parts, codes), _GRAMS)
    tables = grams.groupBy("part", "kind").applyInArrow(_counted, _COUNTS)
    answers = tables.repartition(dealt, "batch").groupBy("batch").agg(F.collect_list(F.struct("kind", "part", "counts")).alias("answers"))
    joined = batches.join(answers, "batch", "left")
    costs = joined.mapInArrow(_scored(order, parts, codes, discount, min_count, words, id_type), _COSTS.format(kind.simpleString()))
    scored = costs.groupBy("batch", "nth").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("cost_micronats").alias("cost_micronats"))
    per_word = F.when(F.col("n_words") > 0, F.expr("cost_micronats div n_words"))
    return scored.select("doc_id", "n_words", "cost_micronats", per_word.alias("cost_per_word"))
