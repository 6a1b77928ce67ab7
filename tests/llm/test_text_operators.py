"""Scoring, SimHash, toxicity and mixing against brute force, with awkward rows."""

import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from manifolder.llm import entries, lm_score, mixing, simhash, toxicity
from manifolder.llm.runtime import Workspace
from manifolder.operators.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, size long, fp long, batch string"
LONG = "alpha beta gamma delta " * 6000
ROWS = [
    (1, "The cat sat on the mat", "en", "a", 1, 5, 5, 5, "x"),
    (2, "the CAT sat on the mat", "en", "b", None, 5, 5, 5, "x"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "", 0, 0, 0, 0, ""),
    (5, " \n\t", "en", "a", 0, 0, 0, 0, ""),
    (6, LONG, "en", "a", 0, 0, 0, 0, ""),
    (7, "ÉTÉ été", "fr", "\U0001f600", 0, 0, 0, 0, ""),
    (8, "one", "en", "a", 0, 0, 0, 0, ""),
    (8, "one", "en", "a", 0, 0, 0, 0, ""),
    (9, "the cat sat on the mat again and again", "en", "b", 0, 0, 0, 0, ""),
    (None, "no id here at all", "en", "b", 0, 0, 0, 0, ""),
    (None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_backoff(texts, order=3, least=2):
    grams = [Counter() for _ in range(order)]
    for t in texts:
        w = words(t)
        for n in range(order):
            grams[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
    total = sum(grams[0].values())
    for t in texts:
        w, cost = words(t), 0
        for i in range(len(w)):
            value = 0.0
            for n in range(min(order - 1, i), -1, -1):
                gram = tuple(w[i - n : i + 1])
                if n == 0:
                    value += math.log(grams[0][gram] / total)
                elif grams[n][gram] >= least:
                    value += math.log(grams[n][gram] / grams[n - 1][gram[:-1]])
                    break
                else:
                    value += math.log(0.4)
            cost -= math.floor(value * 1e6 + 0.5)
        yield len(w), cost


@pytest.mark.parametrize(("order", "least"), [(3, 1), (3, 2), (1, 1), (2, 1), (4, 2), (5, 2)])
def test_backoff(docs, spark, monkeypatch, order, least):
    monkeypatch.setattr(lm_score, "_BATCH_BYTES", 20_000)
    monkeypatch.setattr(lm_score, "_PARTITION_BYTES", 20_000)
    got = Counter(tuple(r) for r in lm_score.stupid_backoff(spark, docs, order, min_count=least).collect())
    scores = brute_backoff([r[1] for r in ROWS], order, least)
    assert got == Counter((r[0], n, cost, cost // n if n else None) for r, (n, cost) in zip(ROWS, scores))


def test_backoff_empty(empty, spark):
    assert lm_score.stupid_backoff(spark, empty).count() == 0


def test_packed_rows_round_trip():
    rng = np.random.default_rng(1)
    high = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    low, times, follow = (rng.integers(0, 1 << 16, len(high)).astype(np.uint64) for _ in range(3))
    words, word_times = rng.integers(0, 1 << 48, 700).astype(np.uint64), rng.integers(1, 1 << 40, 700).astype(np.uint64)
    columns = (high, low, times, follow, words, word_times)
    assert all((a == b).all() for a, b in zip(lm_score.unpack(lm_score.pack(*columns)), columns))
    assert lm_score.unpack(lm_score.pack(*[c[:0] for c in columns]))[0].size == 0


def test_contexts_are_told_apart_by_more_than_64_bits():
    high, low = np.array([7, 3, 7, 7, 3], np.uint64), np.array([1, 9, 2, 1, 9], np.uint64)
    first, group = lm_score.grouped(high, low)
    assert group.tolist() == [1, 0, 2, 1, 0] and high[first].tolist() == [3, 7, 7] and low[first].tolist() == [9, 1, 2]


def test_rows_never_outnumber_ngrams():
    """With more hash partitions than n-grams a batch has a row for each context, not for each partition."""
    batch = lm_score.Batch([b"a b c d", b"a b"], {b"a": 0})
    ranges = list(lm_score._ranges(batch.entries(2, True), 1 << 31))
    assert len(ranges) == 3


def brute_fingerprint(text):
    w = " ".join(words(text)).encode().split(b" ") if words(text) else []
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(keys, linked):
    parent = list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if linked(keys[a], keys[b]):
                x, y = parent[a], parent[b]
                parent = [y if p == x else p for p in parent]
    return parent


def test_simhash_components(docs, spark):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(spark, docs).collect())
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    parent = classes(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {p: min((ROWS[k][0] for k in range(len(ROWS)) if parent[k] == p and ROWS[k][0] is not None), default=None) for p in parent}
    assert got == Counter((r[0], format(f, "016x"), least[p]) for r, f, p in zip(ROWS, fps, parent))


def test_simhash_chains_and_dense_lists():
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    values = {base}
    while len(values) < 300:  # chains: each within three bits of some other
        values.add(int(rng.choice(list(values))) ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(1, 4), replace=False)))
    far = {v ^ (0xFFFF << 24) ^ (1 << int(rng.integers(40, 60))) for v in list(values)[:50]}
    array = np.array(sorted(values), np.uint64)
    small = simhash.list_links(array, 3)
    simhash._DENSE, kept = 4, simhash._DENSE
    try:
        assert len(simhash.list_links(array, 3)) == len(small) == len(array) - 1
    finally:
        simhash._DENSE = kept
    assert far


@pytest.mark.parametrize("long", [3, 4096])
def test_simhash_links_match_all_pairs(spark, long):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
    fps += [f ^ (1 << int(b)) if b < 63 else f for f in fps[:30] for b in rng.integers(0, 63, 3)]
    fps += [fps[0] ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in ((0, 8, 16), (3, 30, 60), (9, 10, 62), (20, 28, 36), (1, 33, 41))]
    fps += [fps[1] ^ int(x) for x in rng.integers(0, 1 << 30, 300)]  # share four bytes, most of them no more
    fps = sorted(set(fps))
    links = simhash.fingerprint_links(Workspace(spark, "t"), spark.createDataFrame([(f,) for f in fps], "fp long"), 3, long)
    labels = {r.id: r.component for r in components(spark, links).collect()}
    want = classes(fps, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3)
    same = defaultdict(set)
    for f, p in zip(fps, want):
        same[p].add(labels.get(f, f))
    assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)


def test_position_sets_find_three_differing_bytes():
    sets = simhash.position_sets()
    assert len(sets) == 14
    assert all(any(not set(s) & set(differ) for s in sets) for differ in itertools.combinations(range(8), 3))
    assert (simhash.tally(np.array([0, 0xFF, 0x0101, 1 << 63 | 1], np.uint64)) == [8, 7, 6, 6]).all()


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_long_lists_go_on_whole(size):
    """A list over several batches: all its members go on under each longer key, and its neighbours are linked."""
    rng = np.random.default_rng(6)
    key = 0x0F
    shared = np.sort(rng.choice(1 << 30, 500, replace=False).astype(np.uint64) << np.uint64(32))
    f = np.concatenate([[1, 3], shared, [9 << 20]]).astype(np.uint64)
    s = f & np.uint64(0xFFFFFFFF)
    order = np.lexsort((f, s))
    f, s = f[order], s[order]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(np.full(len(f[a : a + size]), key, np.int16)), pa.array(s[a : a + size].view(np.int64)), pa.array(f[a : a + size].view(np.int64))], names=["p", "s", "f"])
        for a in range(0, len(f), size)
    ]
    rows = [tuple(r.values()) for b in simhash._run_links(3, 50)(batches) for r in b.to_pylist()]
    gone = {(p, b) for p, _, b in rows if p}
    assert gone == {(key | 1 << fifth, int(v)) for fifth in range(4, 8) for v in shared}


def test_representatives_keep_columns(docs, empty, spark):
    kept = simhash.keep_representatives(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9]
    assert simhash.keep_representatives(spark, empty).count() == 0
    assert simhash.simhash_components(spark, empty).count() == 0


def test_long_path_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (300, 301)], "head long, tail long")
    labels = {r.id: r.component for r in components(spark, links).collect()}
    assert {labels[k] for k in range(201)} == {0} and labels[301] == 300


def brute_segments(scores):
    """All maximal-scoring segments by their definition: recursively the best segment, ties to the shorter."""
    out = []

    def split(a, b):
        best = max(((round(sum(scores[i:j]), 9), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 1e-9:
            _, _, i, j = best
            out.append((i, j - 1))
            split(a, i)
            split(j, b)

    split(0, len(scores))
    return sorted(out)


def test_segments_match_definition():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n = int(rng.integers(1, 14))
        own = {k: float(rng.normal(0.2, 1)) for k in range(n) if rng.random() < 0.6}
        scores = [own.get(k, 0.0) - 0.3 for k in range(n)]
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(list(own), list(own.values()), 0.3)]
        assert got == brute_segments(scores), scores


def test_segments_take_linear_time():
    """A million positive tokens whose running sum falls, rises or wanders."""
    walk = np.random.default_rng(1).normal(size=2_000_000).tolist()
    for scores, found in (([1.0, -2.0] * 1_000_000, 1_000_000), ([1.0, -0.9] * 1_000_000, 1), (walk, None)):
        began = time.process_time()
        segments = toxicity.maximal_segments(range(len(scores)), scores, 0.0)
        assert found in (None, len(segments)) and time.process_time() - began < 10  # the square would take hours


def brute_model(rows, prior=0.5, caution=3.0, drift=0.05):
    """Token scores, decay and location from (text, toxic) by their definitions."""
    tokens = [(re.findall(r"\w+", t.lower()), y) for t, y in rows]
    n = Counter(y for _, y in tokens)
    seen = {y: Counter(w for t, z in tokens if z == y for w in set(t)) for y in (0, 1)}
    scores = {}
    for w in seen[0].keys() | seen[1].keys():
        c, x = seen[0][w], seen[1][w]
        if c + x < 4:
            continue
        odds = math.log((x + prior) / (n[1] - x + prior) / ((c + prior) / (n[0] - c + prior)))
        spread = math.sqrt(sum(1 / (v + prior) for v in (x, n[1] - x, c, n[0] - c)))
        if abs(odds) > caution * spread:
            scores[w] = math.copysign(abs(odds) - caution * spread, odds)
    mean = np.mean([len(t) for t, y in tokens if y == 0])
    share = {w: (seen[0][w] + prior) / (n[0] + 1) / mean for w in scores}
    total = lambda d: (1 - sum(share.values())) * math.exp(-d * drift) + sum(share[w] * math.exp(d * (s - drift)) for w, s in scores.items())
    low, high = 1e-6, 5.0
    if total(high) >= 1:
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if total(middle) < 1 else (low, middle)
    decay = high
    best = lambda t: [sum(s) for s in brute_parts([scores.get(w, 0.0) - drift for w in t])]
    peaks = [decay * max(b) - math.log(len(t)) for t, y in tokens if y == 0 and (b := best(t))]
    return scores, decay, np.mean(peaks) - 0.5772156649015329 if peaks else 0.0, best


def brute_parts(scores):
    return [scores[a : b + 1] for a, b in brute_segments(scores)]


def test_fitted_score_by_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(160):
        bad = int(rng.random() < 0.4)
        text = list(rng.choice(words, 12)) + (["vile", "foul"] if rng.random() < (0.9 if bad else 0.05) else [])
        rows.append((k, " ".join(rng.permutation(text)), bad))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(spark, table.drop("toxic"), table.drop("text"))
    train = {}
    for k, t, y in rows:
        if zlib.crc32(str(k).encode()) % 5:
            train[t] = max(y, train.get(t, 0))
    scores, decay, location, best = brute_model(list(train.items()))
    assert model.scores == pytest.approx(scores) and model.decay == pytest.approx(decay, rel=1e-6) and model.location == pytest.approx(location, abs=1e-6)
    level = -math.log(-math.log(0.99))

    def features(text):
        tokens = re.findall(r"\w+", text.lower())
        excess = [decay * s - math.log(max(1, len(tokens))) - location for s in best(tokens)]
        return [1.0, math.log1p(max([0.0, *excess])), math.log1p(sum(x - level for x in excess if x > level))]

    x, y = np.array([features(t) for t in train]), np.array(list(train.values()), float)
    w = np.array(model.weights)
    assert (w[1:] >= 0).all() and w[1:].any()
    used = np.array([True, *(w[1:] > 0)])  # at the optimum of the penalised likelihood its gradient is 0
    assert np.abs((x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-2 * w)[used]).max() < 1e-5
    for r in toxicity.score_documents(table, model).collect():
        want = 1 / (1 + math.exp(-np.dot(features(rows[r.doc_id][1]), w)))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.5)


def test_toxicity_held_out_and_awkward_rows(docs, empty, spark):
    rng = np.random.default_rng(4)
    clean = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(600):
        text, bad = list(rng.choice(clean, 80)), k % 4 == 0
        if bad:
            at = int(rng.integers(0, 70))
            text[at : at + 4] = ["vile", "Rotten,", "vile", "foul"]
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    texts, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, None, None), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark, texts, known)
    got = {r.doc_id: r for r in toxicity.score_documents(texts, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(got[k].predicted == labels[k][2] for k in held)
    span = got[0].passages[0]
    assert "vile" in rows[0][1][span.first : span.last + 1] and 0 <= span.p_value <= 1
    odd = toxicity.score_documents(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score < 0.5 for r in odd)
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == len(ROWS)
    assert toxicity.keep_clean(texts, model).count() == 450
    assert toxicity.fit(spark, empty, known).scores == {}


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [(labels[r.doc_id], r.predicted) for r in entries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = sum(a and b for a, b in found)
    assert hit / sum(b for _, b in found) > 0.9 and hit / sum(a for a, _ in found) > 0.8


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def check_mix(rows, texts):
    sizes = defaultdict(int)
    for _, text, source in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = brute_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    return {s: abs(taken[s] - target[s]) for s in sizes}, largest


def test_mixing(docs, empty, spark):
    rows = mixing.mix_sources(spark, docs).collect()
    assert len(rows) == len(ROWS)
    miss, largest = check_mix(rows, [(r[0], r[1], r[3]) for r in ROWS])
    assert all(miss[s] <= max(1, largest[s]) for s in miss)
    again = mixing.mix_sources(spark, docs.repartition(1)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix_sources(spark, empty).count() == 0


def test_mixing_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    miss, _ = check_mix(mixing.mix_sources(spark, docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert max(miss.values()) <= 60


def test_mixed_documents_repeat_rows(docs, spark):
    plan = mixing.mix_sources(spark, docs)
    rows = mixing.mixed_documents(spark, docs)
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter({k: v for k, v in ((r[0], r[1]) for r in plan.groupBy("doc_id").sum("copies").collect()) if v})


def dual_multiplier(sizes, target, limit=3.0):
    """The multiplier whose capped tilt has ``target`` words, by bisection."""
    low, high = -60.0, math.log(limit) / min(sizes)
    tokens = lambda m: sum(n * min(limit, math.exp(min(50.0, m * n))) for n in sizes)
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if tokens(middle) < target else (low, middle)
    return (low + high) / 2


def brute_copies(rows, target):
    """copies by (doc_id, size, n-th such row) of one source's rows (doc_id, size), before corrections."""
    sizes = [n for _, n in rows if n]
    m, at, out = dual_multiplier(sizes, target) if sizes else 0.0, 0.0, []
    for key, n in sorted(rows, key=lambda r: (r[1], r[0] is None, r[0] or 0)):
        if not n:
            out.append((key, n, 1))
            continue
        rate = min(3.0, math.exp(m * n))
        out.append((key, n, min(3, math.floor(at + rate + 0.5) - math.floor(at + 0.5))))
        at += rate
    return Counter(out)


def test_mixing_is_the_rounded_dual_optimum(spark, docs):
    """Rates are exp(multiplier * size) at most 3, their tokens meet the targets, and copies are their running steps."""
    rng = np.random.default_rng(8)
    rows = [(k if k % 9 else None, "w " * int(n), s) for k, (n, s) in enumerate(zip(rng.integers(0, 60, 400), rng.choice(["a", "b", "c", "d"], 400, p=[0.05, 0.1, 0.35, 0.5])))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = defaultdict(Counter)
    for r in mixing.mix_sources(spark, table, corrections=0).collect():
        got[r.source][r.doc_id, r.size, r.copies] += 1
    by_source = defaultdict(list)
    for k, t, s in rows:
        by_source[s].append((k, t.count("w")))
    targets = brute_targets({s: sum(n for _, n in v) for s, v in by_source.items()})
    assert any(t < sum(n for _, n in by_source[s]) for s, t in targets.items())
    for s, own in by_source.items():
        assert got[s] == brute_copies(own, targets[s]), s


def test_newton_solves_the_dual(spark):
    rows = [("a", 3, 2), ("a", 50, 1), ("b", 100, 3), (None, 7, 4), (None, 1, 1), ("c", 2, 9), ("c", 9000, 1)]
    classes = spark.createDataFrame(rows, "source string, size long, n long")
    whole = {s: sum(n * c for t, n, c in rows if t == s) for s in ("a", "b", None, "c")}
    want = {"a": 3.0 * whole["a"], "b": 0.37 * whole["b"], None: 2.9 * whole[None], "c": 5.0}
    targets = spark.createDataFrame([(s, whole[s], t) for s, t in want.items()], "source string, source_size long, target double")
    solved = {r.source: r for r in mixing.solve_multipliers(classes, targets, Workspace(spark, "t")).collect()}
    for s, t in want.items():
        sizes = [n for u, n, c in rows if u == s for _ in range(c)]
        assert solved[s].residual <= 1e-9 and solved[s].multiplier == pytest.approx(dual_multiplier(sizes, t), abs=1e-7)
    with pytest.raises(RuntimeError, match="residual"):
        mixing.solve_multipliers(classes, targets, Workspace(spark, "t"), turns=1, together=1)


ODD = "doc_id long, text string, source string, _n int, _c string, _k int, _id long, row long, fp string, size string, copies int, `a.b` string, `times` int, tags map<string,int>"


def test_columns_of_any_name_and_type_pass(spark):
    rows = [(1, "one two three", "a", 777, "k", 5, 6, 7, "f", "s", 9, "d", 3, {"x": 1}), (2, "four five", "b", 888, "m", 5, 6, 7, "g", "t", 9, "e", 4, {"y": 2}), (None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, ODD)
    own = {r.doc_id: r for r in docs.collect()}
    mixed, kept = mixing.mixed_documents(spark, docs), simhash.keep_representatives(spark, docs)
    assert mixed.schema == docs.schema and kept.schema == docs.schema
    assert {r.doc_id for r in mixed.collect()} <= set(own) and all(r == own[r.doc_id] for r in mixed.collect())
    assert sorted(kept.collect(), key=str) == sorted(own.values(), key=str)


def test_many_equal_rows(spark):
    """A hundred thousand equal rows, with and without an id: no row is lost, and each meets the rates."""
    docs = spark.range(100_000).selectExpr("if(id % 2 = 0, null, 4L) doc_id", "'same words here' text", "'a' source").unionByName(spark.createDataFrame([(9, "one other text", "b")], "doc_id long, text string, source string"))
    out = mixing.mix_sources(spark, docs).groupBy("source").agg({"*": "count", "copies": "sum"}).collect()
    assert {r[0]: r["count(1)"] for r in out} == {"a": 100_000, "b": 1}
    assert {r[0]: r["sum(copies)"] for r in out} == {"a": 99_998, "b": 3}
    assert simhash.keep_representatives(spark, docs).count() == 2
