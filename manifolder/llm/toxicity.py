"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens carry conservative log-odds of toxic against clean labelled documents
under an informative Dirichlet prior, less a drift that makes clean text score
negative.  A linear-time scan finds every maximal-scoring segment of a text.
The highest segment of a clean text follows an extreme-value law whose decay
comes from the token scores of clean text and whose location is fitted on
clean documents; a segment is significant if a clean text of that length has
one as high with a probability of at most ``significance``.  A document's
evidence is its calibrated segments, turned into a probability by a logistic
fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifolder.llm.runtime import Workspace

_TOKEN = re.compile(r"\w+")
_EULER = 0.5772156649015329


@dataclass(frozen=True)
class Model:
    """Scores of the tokens that tell the classes apart, and the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    decay: float = 1.0
    location: float = 0.0
    significance: float = 0.01
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0)

    @property
    def level(self) -> float:
        """The excess from which on a segment is significant."""
        return -math.log(-math.log1p(-self.significance))


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(first token, last token, score) of all maximal-scoring segments, left to right.

    ``positions`` are the tokens with a score of their own; every token, those
    included, costs ``drift``.  One pass with a stack of candidates.  Each
    candidate knows the nearest one before it that began at a lower running
    score, so the search for that passes over a candidate at most once, and
    the whole takes time in proportion to the positions.
    """
    firsts, lasts, lefts, rights, lower = [], [], [], [], []
    running, previous = 0.0, -1
    for at, score in zip(positions, scores):
        before = running - drift * (at - previous - 1)
        previous = at
        running = before + score - drift
        if score <= drift:
            continue
        first, left, k = at, before, len(lefts) - 1
        while True:
            while k >= 0 and lefts[k] >= left:
                k = lower[k]
            if k < 0 or rights[k] >= running:
                break
            first, left = firsts[k], lefts[k]
            below = lower[k]
            del firsts[k:], lasts[k:], lefts[k:], rights[k:], lower[k:]
            k = below
        firsts.append(first)
        lasts.append(at)
        lefts.append(left)
        rights.append(running)
        lower.append(k)
    return [(f, z, r - b) for f, z, b, r in zip(firsts, lasts, lefts, rights)]


def _found(model: Model, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
    tokens = _TOKEN.findall((text or "").lower())
    own = model.scores
    positions = [k for k, t in enumerate(tokens) if t in own]
    return len(tokens), maximal_segments(positions, [own[tokens[k]] for k in positions], model.drift)


def _excess(model: Model, n: int, score: float) -> float:
    """Calibrated score: the tail probability of ``score`` in clean text is 1 - exp(-exp(-excess))."""
    return model.decay * score - math.log(max(n, 1)) - model.location


def _features(model: Model, n: int, scores: list[float]) -> tuple[float, float]:
    """Of the calibrated score of the highest segment, and of the sum of all that are significant."""
    excesses = [_excess(model, n, s) for s in scores]
    over = sum(x - model.level for x in excesses if x > model.level)
    return math.log1p(max([0.0, *excesses])), math.log1p(over)


def judged(model: Model, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Probability of a text, its tokens and its segments."""
    n, segments = _found(model, text)
    return probability(model, _features(model, n, [s for _, _, s in segments])), n, segments


def probability(model: Model, features: tuple[float, ...]) -> float:
    z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], features))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for ids whose crc32, as text, divides by ``folds``, and for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic): at most ``most`` labelled documents outside the held-out fold, in hash order of ids."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out("_id", folds))
    ids = docs.select(F.col(id_col).alias("_id")).join(known, "_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(ids), "_id").select("text", "toxic")  # ``most`` bounds what is broadcast


def _token_documents(batches):
    """Documents of each class with each token, summed within a task."""
    seen = (Counter(), Counter())
    totals = [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            totals[toxic] += 1
            seen[toxic].update(set(_TOKEN.findall(text.lower())))
    rows = [(t, seen[0][t], seen[1][t]) for t in seen[0].keys() | seen[1].keys()] + [("", *totals)]
    for at in range(0, len(rows), 20_000):
        t, c, x = zip(*rows[at : at + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c, pa.int64()), pa.array(x, pa.int64())], names=["token", "clean", "toxic"])


def _scan(model: Model):
    """Tokens, class and segment scores of training documents."""

    def run(batches):
        for batch in batches:
            found = [_found(model, t) for t in batch.column(0).to_pylist()]
            arrays = [pa.array([n for n, _ in found], pa.int32()), batch.column(1), pa.array([[s for _, _, s in segments] for _, segments in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["n", "toxic", "scores"])

    return run


def _evidence(model: Model):
    """The features and class of scanned documents."""

    def run(batches):
        for batch in batches:
            found = [_features(model, n, scores) for n, scores in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            arrays = [pa.array([f[k] for f in found], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(1)], names=["best", "sum", "toxic"])

    return run


def _decay(model_scores: dict[str, float], clean_share: dict[str, float], drift: float) -> float:
    """The positive root of sum(share * exp(decay * score)) = 1 over tokens of clean text."""
    rest = 1 - sum(clean_share.values())

    def excess(x: float) -> float:
        return rest * math.exp(-x * drift) + sum(clean_share[t] * math.exp(min(500.0, x * (s - drift))) for t, s in model_scores.items()) - 1

    low, high = 1e-6, 5.0
    if excess(high) < 0:
        return high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """A ridge-penalised logistic fit by Newton's method; features that would count against evidence are left out."""
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, used]])
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        worst = int(np.argmin(w[1:])) if used else 0
        if not used or w[1 + worst] >= 0:
            break
        del used[worst]
    out = np.zeros(x.shape[1] + 1)
    out[[0, *(k + 1 for k in used)]] = w
    return tuple(map(float, out))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 20_000, folds: int = 5, least_documents: int = 4, caution: float = 3.0, prior: float = 0.5, drift: float = 0.05, significance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``most`` labelled documents outside the held-out fold.

    That bound is the only one.  The driver gathers two features of each of
    these documents, and the tokens of at least ``least_documents`` of them
    that tell the classes apart, which are the model.  Exact copies count
    once.  A token's score is its log-odds with the Dirichlet prior ``prior``
    on each class, brought towards 0 by ``caution`` standard deviations.
    Without labels of both classes the model scores every text below one half.
    """
    sample = training_rows(docs, labels, most, folds, id_col, text_col)
    ws = Workspace(spark, "toxicity")
    rows = ws.table(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), "training")
    counts = rows.mapInArrow(_token_documents, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_clean or not n_toxic:
        return Model()
    cells = [F.col("toxic") + prior, n_toxic - F.col("toxic") + prior, F.col("clean") + prior, n_clean - F.col("clean") + prior]
    odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    spread = F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])
    sure = counts.where(F.col("clean") + F.col("toxic") >= least_documents).withColumns({"odds": odds, "margin": F.abs(odds) - spread * caution})
    found = {r.token: r for r in sure.where("margin > 0").select("token", "clean", (F.signum("odds") * F.col("margin")).alias("score")).collect()}
    scores = {t: found[t].score for t in sorted(found)}
    scanned = ws.table(rows.mapInArrow(_scan(Model(scores, drift)), "n int, toxic int, scores array<double>"), "scanned")
    clean = scanned.where("toxic = 0")
    mean = max(1.0, clean.agg(F.avg("n")).first()[0])
    decay = _decay(scores, {t: (found[t].clean + prior) / (n_clean + 1) / mean for t in scores}, drift)
    peaks = clean.where(F.size("scores") > 0).agg(F.avg(F.array_max("scores") * decay - F.log(F.greatest("n", F.lit(1))))).first()[0]
    model = Model(scores, drift, decay, peaks - _EULER if peaks is not None else 0.0, significance)
    table = scanned.mapInArrow(_evidence(model), "best double, sum double, toxic int").toArrow()
    features = np.column_stack([table.column(k).to_numpy() for k in range(2)])
    return replace(model, weights=_logistic(features, table.column(2).to_numpy().astype(float)))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, passages) for every row of ``docs``, in one pass without a shuffle.

    passages are the significant segments: first and last character, score,
    and the probability of one as high in a clean text of that length.  Null
    and empty texts have none and get the score of a text without evidence.
    Repeated rows are scored each on their own, null ids too; other columns
    are not read, and an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1):
                text = text.as_py()
                score, n, segments = judged(model, text)
                scores.append(score)
                strong = [s for s in segments if _excess(model, n, s[2]) > model.level]
                if strong:
                    spans = [m.span() for m in _TOKEN.finditer(text.lower())]
                    strong = [{"first": spans[a][0], "last": spans[b][1] - 1, "score": s, "p_value": -math.expm1(-math.exp(-_excess(model, n, s)))} for a, b, s in strong]
                passages.append(strong)
            arrays = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, passage)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted", "passages"])

    schema = f"doc_id {kind}, score double, predicted int, passages array<struct<first:int,last:int,score:double,p_value:double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic; all columns are passed on, whatever their names.

    Null and empty texts stay, as the model scores them below one half unless
    its training documents say otherwise; repeated rows are judged each, and
    an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            clean = [judged(model, t.as_py())[0] < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
