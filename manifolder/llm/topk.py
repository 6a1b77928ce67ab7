"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over m slices of the dimensions.  Queries
and candidates travel as blocks of bounded size, and only lists of k entries
for each query leave a pair of blocks:

1. Every pair makes the local score list of each slice (the k best partial
   scores), and adds up the scores of what is on the lists, and of nothing
   else.  The k-th best of a query over all pairs is a lower bound of its k-th
   best score: the cutoff.
2. The cutoff travels with the query's block.  An entry can only reach it if
   one of its m partial scores reaches cutoff / m, so every pair collects
   those.  By the inequality of Cauchy and Schwarz a partial score is at most
   the product of the lengths of both slices: slices in which no query of the
   block can reach its share are not computed for a candidate, and a candidate
   with no slice left, or whose lengths all together fall short of every
   cutoff, is passed over.  Candidates are blocked in order of their lengths,
   so whole blocks are.
3. What was collected is completed: the partial scores that phase 2 didn't
   compute are, for collected entries alone.  Entries below the cutoff go, and
   the k best of each pair are merged into the k best of all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifolder.llm.runtime import Workspace

_INT64 = (-(1 << 63), (1 << 63) - 1)


def quantised(vector: list[float] | None, scale: float) -> list[int] | None:
    """floor(scale * x) of each component; None if the vector or a component is missing or not finite."""
    if vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    """A block's vectors with zeros up to its widest one; Python integers where products could leave 64 bits."""
    wide = max((len(v) for v in vectors), default=0)
    top = max((abs(x) for v in vectors for x in v), default=0)
    out = np.zeros((len(vectors), wide), np.int64 if top < 1 << 62 else object)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _packed(rows: int, scale: float, id_name: str):
    """Blocks of up to ``rows`` vectors: ids and components as 64-bit integers; rows out of 64 bits as text."""

    def block(ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        matrix = _matrix(vectors)
        exact = matrix.dtype == object
        data = repr(vectors).encode() if exact else matrix.astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([matrix.shape[1]], pa.int32()), pa.array([exact])], names=[id_name, "data", "wide", "exact"])

    def run(batches):
        ids, vectors = [], []
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float) if len(column) else np.zeros(0)
            bounds = np.concatenate([[0], np.cumsum([0 if n is None else n for n in _lengths(column)])])
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            scaled = np.floor(flat * scale)
            small = bool(np.isfinite(scaled).all() and (np.abs(scaled) < 2.0**62).all()) if len(scaled) else True
            whole = scaled.astype(np.int64) if small else None
            for k, key in enumerate(batch.column(0).to_pylist()):
                if key is None or not valid[k]:
                    continue
                a, b = bounds[k], bounds[k + 1]
                vector = whole[a:b].tolist() if small else quantised([None if math.isnan(x) else x for x in flat[a:b].tolist()], scale)
                if vector is None:
                    continue
                ids.append(key)
                vectors.append(vector)
                if len(ids) == rows:
                    yield block(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield block(ids, vectors)

    return run


def _lengths(column) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.list_value_length(column).to_pylist()


def _unpacked(ids: bytes, data: bytes, wide: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    if exact:
        import ast

        return keys, _matrix(ast.literal_eval(data.decode()))
    return keys, np.frombuffer(data, "<i8").reshape(len(keys), wide)


def _cuts(wide: int, slices: int) -> list[slice]:
    """The dimensions of each slice."""
    ends = [wide * k // slices for k in range(slices + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def _operands(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both over the dimensions they share, in a type in which their products and sums are exact."""
    wide = min(queries.shape[1], candidates.shape[1])
    q, c = queries[:, :wide], candidates[:, :wide]
    top = [int(np.abs(x).max()) if x.size else 0 for x in (q, c)]
    bound = top[0] * top[1] * max(1, wide)
    if bound < 1 << 53:
        return q.astype(np.float64), c.astype(np.float64)
    kind = np.int64 if bound < 1 << 63 else object
    return q.astype(kind), c.astype(kind)


def partial_scores(queries: np.ndarray, candidates: np.ndarray, slices: int) -> list[np.ndarray]:
    """Inner products over each slice of the dimensions, exactly; missing components count as 0."""
    q, c = _operands(queries, candidates)
    parts = [q[:, cut] @ c[:, cut].T for cut in _cuts(q.shape[1], slices)]
    return [p if p.dtype == object else p.astype(np.int64) for p in parts]


def _lengths_of(x: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """(rows, slices): the length of each row in each slice, rounded up."""
    with np.errstate(over="ignore"):
        parts = [np.sqrt((x[:, cut].astype(np.float64) ** 2).sum(axis=1)) for cut in cuts]
    return np.minimum(np.stack(parts, axis=1) * (1 + 1e-12), 1e300)  # finite, so that 0 times it is 0


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Exact scores within 64 bits."""
    return np.clip(scores, *_INT64).astype(np.int64) if scores.dtype == object else scores


def _best(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller key."""
    if len(keys) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((keys[some], -scores[some]))[:k]]
    if scores.dtype == object:
        return np.array(sorted(range(len(keys)), key=lambda i: (-scores[i], keys[i]))[:k], np.int64)
    return np.lexsort((keys, -scores))[:k]


def _rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.repeat([f[0] for f in found], [len(f[1]) for f in found]) if found else []
    keys = np.concatenate([f[1] for f in found]) if found else []
    scores = np.concatenate([f[2] for f in found]) if found else []
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(keys, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def _phase_one(k: int, slices: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _unpacked(row["q_ids"], row["q_data"], row["q_wide"], row["q_exact"])
                c_ids, c = _unpacked(row["ids"], row["data"], row["wide"], row["exact"])
                parts, found = partial_scores(q, c, slices), []
                for i, query in enumerate(q_ids):
                    other = np.flatnonzero(c_ids != query)
                    listed = np.unique(np.concatenate([other[_best(c_ids[other], p[i, other], k)] for p in parts]))
                    score = _clipped(sum(p[i, listed] for p in parts))
                    top = _best(c_ids[listed], score, k)
                    found.append((query, c_ids[listed[top]], score[top]))
                yield _rows(found)

    return run


def collected(q: np.ndarray, c: np.ndarray, cutoffs: list[int | None], slices: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query the places and whole scores of what phases 2 and 3 collect, and the partial scores they computed.

    A query without a cutoff collects everything.
    """
    q, c = _operands(q, c)
    cuts = _cuts(q.shape[1], slices)
    long_q, long_c = _lengths_of(q, cuts), _lengths_of(c, cuts)
    # Partial scores are whole: an entry that reaches the cutoff has one of at least the share, rounded up.
    shares = [None if t is None else -(-t // slices) for t in cutoffs]
    open_ = any(t is None for t in cutoffs)
    least = -np.inf if open_ else float(min(cutoffs))
    fits = np.full(len(c), True) if open_ else (long_q.max(axis=0) * long_c).sum(axis=1) >= least
    low = -np.inf if open_ else float(min(shares))
    known = np.zeros((slices, len(c)), bool)  # candidates whose partial scores of a slice are computed
    parts, work = [], 0
    for s, cut in enumerate(cuts):
        known[s] = fits & (long_q[:, s].max(initial=0) * long_c[:, s] >= low)
        some = np.flatnonzero(known[s])
        part = np.zeros((len(q), len(c)), object if q.dtype == object else np.int64)
        product = q[:, cut] @ c[some, cut].T
        part[:, some] = product if product.dtype == object else product.astype(np.int64)
        parts.append(part)
        work += product.size
    places, scores = [], []
    for i in range(len(q)):
        reach = fits.copy() if cutoffs[i] is None else np.zeros(len(c), bool)
        if cutoffs[i] is not None:
            for s in range(slices):
                reach |= known[s] & (parts[s][i] >= shares[i]).astype(bool)
        at = np.flatnonzero(reach)
        total = sum(p[i, at] for p in parts)
        for s, cut in enumerate(cuts):
            rest = np.flatnonzero(~known[s, at])
            if len(rest):
                more = c[at[rest], cut] @ q[i, cut]
                total[rest] += more if more.dtype == object else more.astype(np.int64)
                work += len(rest)
        places.append(at)
        scores.append(_clipped(total))
    return places, scores, work


def _phases_two_and_three(k: int, slices: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _unpacked(row["q_ids"], row["q_data"], row["q_wide"], row["q_exact"])
                c_ids, c = _unpacked(row["ids"], row["data"], row["wide"], row["exact"])
                cutoffs = dict(zip(np.frombuffer(row["cut_ids"], "<i8").tolist(), np.frombuffer(row["cutoffs"], "<i8").tolist()))
                cutoffs, found = [cutoffs.get(query) for query in q_ids.tolist()], []
                for query, cutoff, at, score in zip(q_ids, cutoffs, *collected(q, c, cutoffs, slices)[:2]):
                    keep = c_ids[at] != query
                    if cutoff is not None:
                        keep &= score >= cutoff
                    at, score = at[keep], score[keep]
                    top = _best(c_ids[at], score, k)
                    found.append((query, c_ids[at[top]], score[top]))
                yield _rows(found)

    return run


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 5, scale: float = 256.0, slices: int = 4, query_rows: int = 512, candidate_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others for each row whose id ``every`` divides.

    Components count as floor(scale * x), a score is the inner product, ties
    go to the smaller id.  Rows without an id, and vectors that are null or
    have null or non-finite components, take no part; shorter vectors end in
    zeros.  Rows that repeat an id are one query or candidate each: a
    candidate is listed once for each of its rows, and a query once, with the
    first of its rows by components.  Scores beyond 64 bits stop at its ends, where they tie.
    Queries with no other vector have no rows, nor has an empty table; other
    columns are not read.
    """
    ws = Workspace(spark, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and x is not null and forall(x, v -> v is not null)")
    packed = "binary, data binary, wide int, exact boolean"
    by_length = rows.sortWithinPartitions(F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v).desc())
    candidates = ws.table(by_length.mapInArrow(_packed(candidate_rows, scale, "ids"), f"ids {packed}"), "candidates")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("x").alias("x"))
    queries = ws.table(asked.mapInArrow(_packed(query_rows, scale, "q_ids"), f"q_ids {packed}"), "queries")
    queries = queries.select("q_ids", F.col("data").alias("q_data"), F.col("wide").alias("q_wide"), F.col("exact").alias("q_exact"))
    # The stated query set against all rows, block by block.
    listed = queries.crossJoin(candidates).mapInArrow(_phase_one(k, slices), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    kth = ws.table(kth, "cutoffs")
    with_cutoffs = _join_cutoffs(queries, kth)
    kept = with_cutoffs.crossJoin(candidates).mapInArrow(_phases_two_and_three(k, slices), "query_id long, vec_id long, score long")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _join_cutoffs(queries: DataFrame, kth: DataFrame) -> DataFrame:
    """Query blocks with the ids and cutoffs of their queries; a block is known by its first id."""

    def ids(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                keys = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), keys[0]))], names=["query_id", "block"])

    blocks = queries.select("q_ids").mapInArrow(ids, "query_id long, block long")
    lists = blocks.join(kth, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cuts"))

    def head(batches):
        for batch in batches:
            firsts = [int(np.frombuffer(d, "<i8", 1)[0]) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    def pack(batches):
        for batch in batches:
            rows = batch.to_pylist()
            cut = [r.pop("cuts") or [] for r in rows]
            arrays = [batch.column(k) for k in range(4)]
            arrays += [pa.array([np.array([c[n] for c in cs], "<i8").tobytes() for cs in cut], pa.binary()) for n in ("query_id", "cutoff")]
            yield pa.RecordBatch.from_arrays(arrays, names=["q_ids", "q_data", "q_wide", "q_exact", "cut_ids", "cutoffs"])

    schema = "q_ids binary, q_data binary, q_wide int, q_exact boolean"
    headed = queries.mapInArrow(head, f"block long, {schema}")
    joined = headed.join(lists, "block", "left").select("q_ids", "q_data", "q_wide", "q_exact", "cuts")
    return joined.mapInArrow(pack, f"{schema}, cut_ids binary, cutoffs binary")
