"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at
most three bits differ in at most three bytes, so they share at least five
positional bytes: the guaranteed minimum of the count filter.  Posting lists
of single positional bytes would hold 1/256 of a corpus each, so the index has
a list for each value of each of fourteen sets of four positions: the
four-element sets of 0..7 whose members cancel out under exclusive or.  They
form a Steiner system in which any three positions lie in just one set, and
the set's complement is one of the fourteen, too; so wherever the three
differing bytes are, some set has none of them and the pair meets in its list.

A list holds pairs that share four bytes and no more, as well.  Pairs are
tallied by their shared positional bytes, those that reach the guaranteed
minimum are kept, and these are verified by their differing bits.  Members of
a list that grows long go on to longer keys, of the list's positions and each
fifth one: any pair that reaches the minimum shares one of those, and such a
list has at most 2 ** 24 distinct members.

From each list only a spanning forest of its verified links leaves the task,
so a group of thousands of near copies yields links in proportion to its
members, and connectivity stays exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifolder.llm.runtime import Workspace, column, numbered
from manifolder.operators.graph import components

#: Members from which on a list is split by a fifth position.
_LONG = 4096

#: Below this many members a list with a fifth position is compared all against all.
_DENSE = 2048

#: Differing bits up to which the index finds all pairs.
MOST_BITS = 3


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles of a whole text, repeats counted.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    A text of fewer words is one shingle; one without words gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    n = len(starts)
    values = np.fromiter((hashed(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    rows = values.astype(">u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 16384):
        ones += np.unpackbits(rows[at : at + 16384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row for each row of ``docs``; fp is the signed view of 64 bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def position_sets() -> list[tuple[int, ...]]:
    """The fourteen sets of four of the eight positions in which any three positions lie together once."""
    return [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _postings(fps: DataFrame) -> DataFrame:
    """(positions, shared, fp): an entry for each fingerprint in each of its lists; positions is a bit for each."""
    entries = []
    for kept in position_sets():
        shared = F.col("fp").bitwiseAND(F.lit(_signed(_mask(kept))))
        entries.append(F.struct(F.lit(sum(1 << p for p in kept)).cast("short").alias("positions"), shared.alias("shared")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.positions", "e.shared", "fp")


def tally(x: np.ndarray) -> np.ndarray:
    """Positional bytes that two fingerprints share, from their exclusive or."""
    return 8 - (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8) != 0).sum(axis=1)


def _near(x: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs reach the guaranteed minimum of the tally and, verified, differ in few enough bits."""
    found = np.flatnonzero(tally(x) >= 8 - distance)
    return found[np.bitwise_count(x[found]) <= distance]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def list_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one posting list of distinct fingerprints.

    Short lists compare all members; in longer ones every member looks up the
    fingerprints that its free bits can reach, so the work for m members is
    the smaller of m * m / 2 and m times the number of reachable patterns.
    """
    values = np.sort(values)
    m = len(values)
    parent = np.arange(m)
    free = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [1 << b for b in range(64) if free >> b & 1]
    reach = sum(len(list(combinations(bits, r))) for r in range(1, distance + 1)) if len(bits) <= 32 else 1 << 62

    def union(left, right):
        for a, b in zip(left.tolist(), right.tolist()):
            ra, rb = _find(parent, a), _find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)

    if m <= _DENSE or m // 2 <= reach:
        for i in range(m - 1):
            near = _near(values[i + 1 :] ^ values[i], distance) + i + 1
            union(np.full(len(near), i), near)
    else:
        for r in range(1, distance + 1):
            for flip in combinations(bits, r):
                other = values ^ np.uint64(sum(flip))
                at = np.searchsorted(values, other)
                hit = np.flatnonzero((at < m) & (values[np.minimum(at, m - 1)] == other) & (at > np.arange(m)))
                union(hit, at[hit])
    roots = [_find(parent, i) for i in range(m)]
    return [(int(values[i]), int(values[r])) for i, r in enumerate(roots) if i != r]


def _split(positions: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a list's members under its positions and each fifth one."""
    longer = [positions | 1 << p for p in range(8) if not positions >> p & 1]
    masks = [np.uint64(_mask(tuple(p for p in range(8) if five >> p & 1))) for five in longer]
    return np.repeat(longer, len(values)), np.concatenate([values & m for m in masks]), np.tile(values, len(longer))


_ENTRIES = "positions short, a long, b long"


def _batch(positions, a, b) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(positions, np.int16)), *(pa.array(np.asarray(c, np.uint64).view(np.int64)) for c in (a, b))]
    return pa.RecordBatch.from_arrays(columns, names=["positions", "a", "b"])


def _run_links(distance: int, long: int | None):
    """Links (0, a, b) of sorted postings, and the entries (positions, shared, fp) that longer lists go on to.

    Lists are cut off at their ends wherever batches break; of one with more
    than ``long`` members no more than a batch is held.
    """

    def links_of(p, s, f):
        edges = np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1])) + 1
        starts = np.concatenate([[0], edges])
        sizes = np.diff(np.concatenate([starts, [len(f)]]))
        pairs = starts[sizes == 2]  # most lists of more than one member
        near = pairs[_near(f[pairs] ^ f[pairs + 1], distance)]
        left, right = f[near].tolist(), f[near + 1].tolist()
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if long is not None and n > long:
                yield _batch(*_split(int(p[at]), f[at : at + n]))
                continue
            for a, b in list_links(f[at : at + n], distance):
                left.append(a)
                right.append(b)
        yield _batch(np.zeros(len(left)), left, right)

    def run(batches):
        held: list[tuple] = []
        splitting = None  # the key of a long list whose members so far have gone on
        for batch in batches:
            if not batch.num_rows:
                continue
            p, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            f = batch.column(2).to_numpy().view(np.uint64)
            if splitting is not None:
                own = int(np.searchsorted((p != splitting[0]) | (s != splitting[1]), True))
                if own:
                    yield _batch(*_split(splitting[0], f[:own]))
                p, s, f = p[own:], s[own:], f[own:]
                if not len(f):
                    continue
                splitting = None
            last = np.flatnonzero((p != p[-1]) | (s != s[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (p[0], s[0])):
                whole = [np.concatenate(c) for c in zip(*held, (p[:cut], s[:cut], f[:cut]))]
                if len(whole[2]):
                    yield from links_of(*whole)
                held = []
            held.append((p[cut:], s[cut:], f[cut:]))
            if long is not None and sum(len(h[2]) for h in held) > long:
                splitting = (int(p[-1]), int(s[-1]))
                yield _batch(*_split(splitting[0], np.concatenate([h[2] for h in held])))
                held = []
        if held:
            yield from links_of(*[np.concatenate(c) for c in zip(*held)])

    return run


def fingerprint_links(ws: Workspace, fps: DataFrame, distance: int = 3, long: int = _LONG) -> DataFrame:
    """(head, tail): links whose closure is that of all pairs of ``fps`` (fp) within ``distance`` bits, 3 at most."""
    if not 0 <= distance <= MOST_BITS:
        raise ValueError(f"the index finds pairs of at most {MOST_BITS} differing bits")

    def met(postings: DataFrame, most: int | None) -> DataFrame:
        dealt = postings.repartition("positions", "shared").sortWithinPartitions("positions", "shared")
        return dealt.mapInArrow(_run_links(distance, most), _ENTRIES)

    found = ws.table(met(_postings(fps.select("fp").where("fp is not null").distinct()), long), "met")
    links = found.where("positions = 0")
    entries = found.where("positions <> 0").select("positions", F.col("a").alias("shared"), F.col("b").alias("fp"))
    if not entries.isEmpty():
        links = links.unionByName(met(entries.distinct(), None))
    return ws.table(links.select(F.col("a").alias("head"), F.col("b").alias("tail")).distinct(), "links")


def _labels(spark: SparkSession, ws: Workspace, fps: DataFrame, distance: int) -> DataFrame:
    """(fp, label) for fingerprints with links: the smallest one reachable."""
    return components(spark, fingerprint_links(ws, fps, distance)).select(F.col("id").alias("fp"), F.col("component").alias("label"))


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most
    ``distance`` differing bits.  Equal fingerprints are linked, so repeated
    rows and all empty or null texts (fingerprint zero) share a component.  A
    null id keeps its row and is passed over as a component's smallest id,
    unless it is the only one.  An empty table gives an empty result.  Other
    columns of ``docs`` are not read.
    """
    ws = Workspace(spark, "simhash")
    fps = ws.table(fingerprints(docs, id_col, text_col, width), "fps")
    labels = _labels(spark, ws, fps, distance)
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    grouped = least.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    roots = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(roots, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.

    Rows are told apart by their places in the table, not by their ids, so
    texts that repeat an id or have none each stand for their own component.
    Rows with an id come before those without; of equal ids those without a
    text come first, then it goes by hashes of the text and the other columns.  Null and empty texts are one component.
    All columns are passed on, whatever their names and types; an empty table
    stays empty.
    """
    ws = Workspace(spark, "representatives")

    @F.arrow_udf("long")
    def of_text(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts)).view(np.int64))

    text = column(text_col).cast("string")
    others = [column(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    other = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    whole, row = numbered(ws, docs)
    place = F.struct(
        column(id_col).isNull().alias("none"), column(id_col).alias("id"), text.isNotNull().alias("some"), F.xxhash64(text).alias("text"),
        other.alias("other"), column(row).alias("row"),
    )
    placed = whole.select(of_text(text).alias("fp"), place.alias("place"))
    firsts = ws.table(placed.groupBy("fp").agg(F.min("place").alias("first")), "firsts")
    labels = _labels(spark, ws, firsts, distance)
    kept = firsts.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return whole.join(kept, row, "left_semi").select(*[column(c) for c in docs.columns])
