"""DuckDB SQL of the deterministic queries, built from shared common table expressions."""

from __future__ import annotations

import math

K, EPOCHS, A, B = 15, 200, 1.577, 0.8951

POINTS = "p AS (SELECT vec_id AS id, [v::DOUBLE FOR v IN embedding] AS x, label FROM embeddings)"
_D2 = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip({a}, {b})])"
_DOT = "list_sum([z[1] * z[2] FOR z IN list_zip({a}, {b})])"


def _d2(a: str, b: str) -> str:
    return _D2.format(a=a, b=b)


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


EUCLIDEAN = f"sqrt(sqrt({_d2('a.x', 'b.x')}))"
COSINE = f"sqrt(greatest(0.0, 1.0 - {_dot('a.x', 'b.x')} / sqrt({_dot('a.x', 'a.x')} * {_dot('b.x', 'b.x')})))"


def _knn(distance: str = EUCLIDEAN, k: int = K, name: str = "knn", points: str = "p") -> str:
    return f"""{name} AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, (i <> j)::INT, j)::INT AS rank
      FROM (SELECT a.id AS i, b.id AS j, {distance} AS d FROM {points} a, {points} b) QUALIFY rank <= {k})"""


def _sigma(pseudo: bool = True, k: int = K) -> str:
    t = "e - rho" if pseudo else "e"
    total = "list_sum([CASE WHEN e > 0 THEN exp(-e / mid) ELSE 1.0 END FOR e IN t])"
    return f"""c AS (SELECT i, list(d ORDER BY rank) AS ds, coalesce(min(d) FILTER (d > 0), 0) AS rho FROM knn GROUP BY i),
    s AS (SELECT i, rho, [{t} FOR e IN ds[2:]] AS t, 0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1::DOUBLE AS mid, 0 AS n FROM c
      UNION ALL
      SELECT i, rho, t, CASE WHEN f > {math.log2(k)!r} THEN lo ELSE mid END, CASE WHEN f > {math.log2(k)!r} THEN mid ELSE hi END,
        CASE WHEN f > {math.log2(k)!r} THEN (lo + mid) / 2 WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END, n + 1
      FROM (SELECT *, {total} AS f FROM s WHERE n < 64) WHERE abs(f - {math.log2(k)!r}) >= 1e-5),
    cal AS (SELECT i, any_value(rho) AS rho, arg_max(mid, n) AS sigma FROM s GROUP BY i)"""


def _sim(pseudo: bool = True) -> str:
    shift = "d - rho" if pseudo else "d"
    return f"""sim AS (SELECT i, j, CASE WHEN d - rho <= 0 OR sigma = 0 THEN 1.0 ELSE exp(-({shift}) / sigma) END AS p
      FROM knn JOIN cal USING (i) WHERE i <> j)"""


def _sym(umap: bool = True) -> str:
    w = "p + q - p * q" if umap else "(p + q) / 2"
    return f"""e AS (SELECT head, tail, {w} AS w FROM (
        SELECT coalesce(a.i, b.j) AS head, coalesce(a.j, b.i) AS tail, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q
        FROM sim a FULL JOIN sim b ON a.i = b.j AND a.j = b.i) WHERE {w} <> 0)"""


PRUNED = f"g AS (SELECT * FROM e WHERE w >= (SELECT max(w) FROM e) / {EPOCHS})"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


GRAPH = (POINTS, _knn(), _sigma(), _sim(), _sym())
NEAR = (POINTS, _knn())
FLAT = """lows AS (SELECT min(x[1]) AS l0, min(x[2]) AS l1, greatest(max(x[1]) - min(x[1]), max(x[2]) - min(x[2])) AS top FROM p),
  flat AS (SELECT id, label, (x[1] - l0) / (top / 10) AS y0, (x[2] - l1) / (top / 10) AS y1 FROM p, lows)"""


def _forces(normalized: bool, frobenius: bool) -> str:
    q = f"(1.0 / (1.0 + pow(d2, {B}) * {A}))"
    if frobenius:
        attr = f"0.5 * ({q} * {q} + {q} * {q} * {q} * 2)" if normalized else f"0.5 * {q} * {q}"
        rep = f"({q} * {q} * {q} + {q} * {q} * {q} * {q} * 2)" if normalized else f"({q} * {q} * {q})"
    elif normalized:
        attr, rep = f"0.5 * {q}", f"({q} * {q})"
    else:
        attr = f"CASE WHEN d2 > 0 THEN 0.5 * (pow(d2, {B} - 1) * (2.0 * {A} * {B}) / (pow(d2, {B}) * {A} + 1)) ELSE 0 END"
        q = f"((2.0 * {B}) / ((d2 + 0.001) * (pow(d2, {B}) * {A} + 1)))"
        rep = f"({q} * (1 - 0.25))"
    d2 = "f AS (SELECT i, j, (a.y0 - b.y0) * (a.y0 - b.y0) + (a.y1 - b.y1) * (a.y1 - b.y1) AS d2 FROM knn JOIN flat a ON a.id = i JOIN flat b ON b.id = j WHERE i <> j)"
    return _with(*NEAR, FLAT, d2) + f"SELECT i, j, round({attr}, 6) AS attraction, round({rep}, 6) AS repulsion, round({q}, 6) AS q FROM f"


def _epoch(normalized: bool) -> str:
    weight = "w / (SELECT sum(w) FROM g)" if normalized else "w"
    kernel = "(1 / (1 + {}))"
    attr = f"w * 4 * {kernel.format('da')}" if normalized else "CASE WHEN da > 0 THEN w * 2 / (da + 1) ELSE 0 END"
    q = kernel.format("dr") if normalized else "(2 / ((dr + 0.001) * (dr + 1)))"
    rep = f"{q} * {q}" if normalized else f"{q} * (1 - (SELECT avg(w) FROM h))"
    rate = "(SELECT count(*) FROM p) / 500.0" if normalized else f"1.0 * (1 - 1.0 / {EPOCHS})"
    both = "" if normalized else "UNION ALL SELECT tail, fa * (h0 - t0), fa * (h1 - t1), 0, 0, 0 FROM f"
    z = "(SELECT sum(q) FROM o)" if normalized else "1"
    step = "greatest(-1, least(1, 4 * (coalesce(a{k}, 0) + coalesce(r{k}, 0) / {z}) * 0.8)) * {rate}"
    return _with(*GRAPH, PRUNED, FLAT, f"""h AS (SELECT head, tail, {weight} AS w FROM g),
      t AS (SELECT w, head, tail, a.y0 AS h0, a.y1 AS h1, b.y0 AS t0, b.y1 AS t1, c.y0 AS r0, c.y1 AS r1 FROM h JOIN flat a ON a.id = head JOIN flat b ON b.id = tail
        JOIN flat c ON c.id = (head * 31 + tail * 17 + 1) % (SELECT count(*) FROM p)),
      d AS (SELECT *, (h0 - t0) * (h0 - t0) + (h1 - t1) * (h1 - t1) AS da, (h0 - r0) * (h0 - r0) + (h1 - r1) * (h1 - r1) AS dr FROM t),
      f AS (SELECT *, {attr} AS fa, {rep} AS fr, {q} AS q FROM d),
      o AS (SELECT head AS id, -fa * (h0 - t0) AS a0, -fa * (h1 - t1) AS a1, fr * (h0 - r0) AS r0, fr * (h1 - r1) AS r1, q FROM f {both}),
      n AS (SELECT id, sum(a0) AS a0, sum(a1) AS a1, sum(r0) AS r0, sum(r1) AS r1 FROM o GROUP BY id)""") + f"""
      SELECT flat.id, round(y0 + {step.format(k=0, z=z, rate=rate)}, 5) AS y0, round(y1 + {step.format(k=1, z=z, rate=rate)}, 5) AS y1, round(0.8::DOUBLE, 3) AS gain
      FROM flat LEFT JOIN n USING (id)"""


def _umap_epoch() -> str:
    turn = "(visits + 1) * every <= 7"
    due = "greatest(floor((7 - CASE WHEN visits > 0 THEN pace * (greatest(floor((ceil(visits * every) - pace) / pace), 0) + 1) ELSE pace END) / pace), 0)::INT"
    clip = "greatest(-4, least(4, {}))"
    return _with(*GRAPH, PRUNED, FLAT, f"""v AS (SELECT head, tail, top / w AS every FROM g, (SELECT max(w) AS top FROM g)),
      t AS (SELECT *, greatest(floor(6 / every), 0) AS visits, every / 5 AS pace FROM v),
      o AS (SELECT head, tail, {due} AS due FROM t WHERE {turn}),
      m AS (SELECT head, tail, a.y0 AS h0, a.y1 AS h1, b.y0 AS t0, b.y1 AS t1, (a.y0 - b.y0) * (a.y0 - b.y0) + (a.y1 - b.y1) * (a.y1 - b.y1) AS d2 FROM o JOIN flat a ON a.id = head JOIN flat b ON b.id = tail),
      f AS (SELECT *, CASE WHEN d2 > 0 THEN 2 / (d2 + 1) ELSE 0 END AS f FROM m),
      x AS (SELECT head, (head * 31 + tail * 17 + k * 7 + 1) % (SELECT count(*) FROM p) AS r FROM o, LATERAL (SELECT unnest(range(due)) AS k)),
      z AS (SELECT head, a.y0 AS h0, a.y1 AS h1, b.y0 AS r0, b.y1 AS r1, (a.y0 - b.y0) * (a.y0 - b.y0) + (a.y1 - b.y1) * (a.y1 - b.y1) AS d2 FROM x JOIN flat a ON a.id = head JOIN flat b ON b.id = r),
      q AS (SELECT *, 2 / ((d2 + 0.001::DOUBLE) * (d2 + 1)) AS f FROM z),
      u AS (SELECT head AS id, -{clip.format('f * (h0 - t0)')} AS g0, -{clip.format('f * (h1 - t1)')} AS g1 FROM f
        UNION ALL SELECT tail, {clip.format('f * (h0 - t0)')}, {clip.format('f * (h1 - t1)')} FROM f
        UNION ALL SELECT head, {clip.format('f * (h0 - r0)')}, {clip.format('f * (h1 - r1)')} FROM q),
      n AS (SELECT id, sum(g0) AS g0, sum(g1) AS g1 FROM u GROUP BY id)""") + f"""
      SELECT id, round(y0 + coalesce(g0, 0) * (1 - 7.0::DOUBLE / {EPOCHS}), 5) AS y0, round(y1 + coalesce(g1, 0) * (1 - 7.0::DOUBLE / {EPOCHS}), 5) AS y1 FROM flat LEFT JOIN n USING (id)"""


def _tsne_epoch() -> str:
    step = "greatest(-1, least(1, 4 * (coalesce(a{k}, 0) + r{k} / (SELECT sum(q) FROM r)) * 0.8::DOUBLE * ((SELECT count(*) FROM p) / 500.0::DOUBLE)))"
    return _with(*NEAR, _sigma(), _sim(), _sym(False), PRUNED, FLAT, """h AS (SELECT head, tail, w / (SELECT sum(w) FROM g) AS w FROM g),
      t AS (SELECT head, w, a.y0 - b.y0 AS d0, a.y1 - b.y1 AS d1 FROM h JOIN flat a ON a.id = head JOIN flat b ON b.id = tail),
      a AS (SELECT head AS id, sum(-w * 4 / (1 + d0 * d0 + d1 * d1) * d0) AS a0, sum(-w * 4 / (1 + d0 * d0 + d1 * d1) * d1) AS a1 FROM t GROUP BY head),
      d AS (SELECT a.id, a.y0 - b.y0 AS d0, a.y1 - b.y1 AS d1 FROM flat a JOIN flat b ON a.id <> b.id),
      k AS (SELECT id, d0, d1, 1 / (1 + d0 * d0 + d1 * d1) AS q FROM d),
      r AS (SELECT id, sum(q) AS q, sum(q * q * d0) AS r0, sum(q * q * d1) AS r1 FROM k GROUP BY id)""") + f"""
      SELECT id, round(y0 + {step.format(k=0)}, 5) AS y0, round(y1 + {step.format(k=1)}, 5) AS y1 FROM flat JOIN r USING (id) LEFT JOIN a USING (id)"""


def _uniform(seed: int, *keys: str) -> str:
    """The whole-number hashes of the generators."""
    x = str(seed % 2147483647)
    for key in keys:
        x = f"[(v * v + 54321) % 2147483647 FOR v IN [(v * v + 12345) % 2147483647 FOR v IN [({x}::BIGINT * 48271 + ({key})::BIGINT % 2147483647) % 2147483647]]][1]"
    return f"(({x} + 0.5::DOUBLE) / 2147483647)"


def _normal(seed: int, *keys: str) -> str:
    return f"(sqrt(ln({_uniform(2 * seed, *keys)}) * -2) * cos({_uniform(2 * seed + 1, *keys)} * {2 * math.pi!r}))"


def _generated(n: int, columns: dict[str, str], label: str) -> str:
    return f"SELECT id, {', '.join(f'round({v}, 6) AS {k}' for k, v in columns.items())}, {label} AS label FROM (SELECT range AS id FROM range({n}))"


_T = f"(({_uniform(0, 'id')} * 2 + 1) * {1.5 * math.pi!r})"
_DBSCAN = (
    "k AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 5)",
    "l AS (SELECT i AS u, j AS v FROM n WHERE i IN (SELECT i FROM k) AND j IN (SELECT i FROM k))",
    "r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)",
    "c AS (SELECT u, min(v) AS c FROM r GROUP BY u)",
    "b AS (SELECT i, min(c) AS c FROM n JOIN c ON u = j GROUP BY i)",
)


def _field(kind: str) -> str:
    least = {
        "pca": "4 * (x * x - y * y) * y",
        "tsne": "4 * (exp(-x * x) - q) * q * y",
        "frob_tsne": "4 * (exp(-x * x) - q) * (q * q + 2 * q * q * q) * q * y",
        "umap": "(exp(-x * x) * 2 * q - (1 - exp(-x * x)) * 2 / ((y * y + 0.001) * (y * y + 1))) * y",
        "frob_umap": "(exp(-x * x) * (1 / (1 + x * x)) * (1 / (1 + x * x)) - q * q * q) * y",
    }[kind]
    return f"""WITH v AS (SELECT i::INT AS place, i * (4.0::DOUBLE / 39) AS v FROM range(40) t(i)),
      g AS (SELECT a.place AS x_place, (39 - b.place)::INT AS y_place, a.v AS x, b.v AS y, 1 / (1 + b.v * b.v) AS q FROM v a, v b)
      SELECT x_place, y_place, round(x, 6) AS x, round(y, 6) AS y, round({least}, 5) + 0.0 AS grad FROM g"""


_COMPONENTS = (
    "l AS (SELECT head AS u, tail AS v FROM n UNION SELECT tail, head FROM n UNION SELECT id, id FROM p)",
    "r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)",
)

SQL = {
    "knn_euclidean": _with(*NEAR) + "SELECT i, j, rank, round(d, 6) AS d FROM knn",
    "knn_cosine": _with(POINTS, _knn(COSINE)) + "SELECT i, j, rank, round(d, 6) AS d FROM knn",
    "knn_expressions": _with(POINTS, _knn(k=5)) + "SELECT i, j, rank, round(d, 6) AS d FROM knn",
    "knn_callable": _with(POINTS, _knn("sqrt((a.x[1] - b.x[1]) * (a.x[1] - b.x[1]))", 4)) + "SELECT i, j, rank, round(d, 6) AS d FROM knn",
    "mutual_neighbors": _with(*NEAR) + "SELECT a.i, a.j FROM knn a JOIN knn b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j",
    "recall_overlap": _with(POINTS, _knn(), _knn(COSINE, name="other")) + "SELECT round(count(o.i) / count(*), 6) AS recall FROM knn k LEFT JOIN other o ON k.i = o.i AND k.j = o.j",
    "calibration": _with(*NEAR, _sigma()) + "SELECT i, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM cal",
    "calibration_plain": _with(*NEAR, _sigma(False)) + "SELECT i, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM cal",
    "similarity_pseudo": _with(*NEAR, _sigma(), _sim()) + "SELECT i, j, round(p, 5) AS p FROM sim",
    "similarity_plain": _with(*NEAR, _sigma(False), _sim(False)) + "SELECT i, j, round(p, 5) AS p FROM sim",
    "fuzzy_graph": _with(*GRAPH) + "SELECT head, tail, round(w, 5) AS w FROM e",
    "mean_graph": _with(*NEAR, _sigma(), _sim(), _sym(False)) + "SELECT head, tail, round(w, 5) AS w FROM e",
    "pruned_graph": _with(*GRAPH, PRUNED) + "SELECT head, tail, round(w, 5) AS w FROM g",
    "sampling_schedule": _with(*GRAPH, PRUNED) + "SELECT head, tail, round((SELECT max(w) FROM g) / w, 3) AS epochs_per_sample FROM g",
    "vertex_degrees": _with(*GRAPH) + "SELECT tail AS id, count(*) AS degree, round(sum(w), 4) AS weight FROM e GROUP BY tail",
    "edge_statistics": _with(*GRAPH) + "SELECT count(*) AS n_edges, round(sum(w), 2) AS total, round(avg(w), 5) AS mean, round(max(w), 5) AS largest, round(min(w), 5) AS smallest FROM e",
    "normalized_weights": _with(*GRAPH) + "SELECT head, tail, round(w / (SELECT sum(w) FROM e), 8) AS w FROM e",
    "coalesced_edges": _with(POINTS, _knn(), _knn(COSINE, name="other")) + "SELECT i AS head, j AS tail, round(sum(d), 5) AS w FROM (SELECT i, j, d FROM knn UNION ALL SELECT i, j, d FROM other) WHERE i <> j GROUP BY i, j HAVING sum(d) <> 0",
    "degree_pruned_edges": _with(*NEAR) + "SELECT i AS head, j AS tail, round(d, 6) AS w FROM knn QUALIFY d <= coalesce(nth_value(d, 9) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), d)",
    "edge_offsets": _with(*GRAPH) + "SELECT head, count(*) AS degree, (sum(count(*)) OVER (ORDER BY head) - count(*))::BIGINT AS first FROM e GROUP BY head",
    "graph_components": _with(POINTS, _knn(k=2), "n AS (SELECT i AS head, j AS tail FROM knn WHERE i <> j)", *_COMPONENTS) + "SELECT u AS id, min(v) AS component FROM r GROUP BY u",
    "label_centroids": _with(POINTS) + "SELECT \"group\", pos, round(avg(v), 6) AS v FROM (SELECT label AS \"group\", unnest(x) AS v, (generate_subscripts(x, 1) - 1)::INT AS pos FROM p) GROUP BY \"group\", pos",
    "centroid_affinities": _with(POINTS, "m AS (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM p) GROUP BY label, pos)") + "SELECT a.label AS a, b.label AS b, round(exp(-sum((a.v - b.v) * (a.v - b.v))), 6) AS affinity FROM m a JOIN m b USING (pos) GROUP BY a.label, b.label",
    "vector_functions": _with(POINTS) + f"""SELECT a.id AS i, round(sqrt({_d2('a.x', 'b.x')}), 6) AS euclidean, round(1 - {_dot('a.x', 'b.x')} / sqrt({_dot('a.x', 'a.x')} * {_dot('b.x', 'b.x')}), 6) AS cosine,
      round({_dot('a.x', 'b.x')} / sqrt({_dot('a.x', 'a.x')} * {_dot('b.x', 'b.x')}), 6) AS angular, round(sqrt({_dot('a.x', 'a.x')}), 6) AS norm, round((a.x[1] - b.x[1]) / (1e-6 + sqrt({_d2('a.x', 'b.x')})), 6) AS grad_first
      FROM p a JOIN p b ON b.id = a.id + 1""",
    "forces_kl": _forces(False, False),
    "forces_kl_normalized": _forces(True, False),
    "forces_frobenius": _forces(False, True),
    "forces_frobenius_normalized": _forces(True, True),
    "blended_epoch": _epoch(False),
    "blended_epoch_normalized": _epoch(True),
    "neighbor_accuracy": _with(POINTS, "n AS (SELECT count(*) // 10 AS size FROM p)", f"""q AS (SELECT a.id AS i, a.label AS own, a.id // size AS fold, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {_d2('a.x', 'b.x')}, b.id) AS r
      FROM p a, p b, n WHERE a.id // size < 9 AND a.id // size <> b.id // size QUALIFY r <= 100)""", "v AS (SELECT i, fold, own, label, count(*) AS n FROM q GROUP BY ALL)", "w AS (SELECT i, fold, own, label FROM v QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, label) = 1)") + "SELECT round(avg(a), 6) AS accuracy FROM (SELECT avg((own = label)::INT) AS a FROM w GROUP BY fold)",
    "v_measure": _with(POINTS, "a AS (SELECT label, (x[1] > 0)::INT * 2 + (x[2] > 0)::INT AS c FROM p)", """n AS (SELECT label, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS l, sum(count(*)) OVER (PARTITION BY c) AS k, sum(count(*)) OVER () AS t FROM a GROUP BY label, c)""",
      "s AS (SELECT 1 - sum(-n / t * ln(n / k)) / sum(-n / t * ln(l / t)) AS h, 1 - sum(-n / t * ln(n / l)) / sum(-n / t * ln(k / t)) AS c FROM n)") + "SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure FROM s",
    "class_distances": _with(POINTS, "m AS (SELECT min(list_min(x)) AS lo, max(list_max(x)) AS hi FROM p)", "z AS (SELECT id, label, [(v - lo) / (hi - lo) - 0.5 FOR v IN x] AS x FROM p, m)", f"d AS (SELECT a.label AS a, b.label AS b, sqrt({_d2('a.x', 'b.x')}) AS d FROM z a JOIN z b ON a.label < b.label)") + "SELECT a, b, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY d) = count(*) OVER (PARTITION BY a, b) // 10 + 1",
    "class_distances_as_published": _with(POINTS, "m AS (SELECT min(list_min(x)) AS lo, max(list_max(x)) AS hi FROM p)", "z AS (SELECT id, label, [(v - lo) / (hi - lo) - 0.5 FOR v IN x] AS x FROM p, m)", f"d AS (SELECT a.label AS a, sqrt({_d2('a.x', 'b.x')}) AS d FROM z a JOIN z b ON a.label = b.label)", "o AS (SELECT a, d FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = count(*) OVER (PARTITION BY a) // 10 + 1)") + "SELECT a, l.label AS b, round(d, 6) AS distance FROM o JOIN (SELECT DISTINCT label FROM p) l ON a < l.label",
    "intra_inter_distance": _with(POINTS, f"d AS (SELECT a.label = b.label AS same, sqrt({_d2('a.x', 'b.x')}) AS d FROM p a JOIN p b ON a.id < b.id)") + "SELECT round(avg(d) FILTER (same), 6) AS intra, round(avg(d) FILTER (NOT same), 6) AS inter FROM d",
    "strided_sample": _with(POINTS) + "SELECT id, label FROM p WHERE id % ((SELECT count(*) FROM p) // 70) = 0",
    "upsampled": _with(POINTS, "n AS (SELECT count(*) AS n FROM p)") + "SELECT id + c * n AS id, label, round(x[1] * pow(2.0, bit_count(c)), 6) AS x0 FROM p, n, range(4) t(c) WHERE id + c * n < 3 * n + 7",
    "stratified_sample": _with(POINTS, "c AS (SELECT label, count(*) AS n FROM p WHERE label IN (1, 4, 7) GROUP BY label)", "r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS r FROM p WHERE label IN (1, 4, 7))", "m AS (SELECT min(n) AS n, greatest(1, min(n) // 5) AS stride FROM c)") + "SELECT id, label FROM r, m WHERE r < n AND r % stride = 0 AND r // stride < 5",
    "scaled_points": _with(POINTS) + "SELECT id, round(x[1] / m, 6) AS x0, round(x[64] / m, 6) AS x63 FROM p, (SELECT max(list_max(x)) AS m FROM p)",
    "rescaled_columns": _with(POINTS, FLAT) + "SELECT id, round(y0, 6) AS x0, round(y1, 6) AS x1 FROM flat",
    "standardized_points": _with(POINTS) + "SELECT id, round((x[1] - lo) / (hi - lo) - 0.5, 6) AS x0 FROM p, (SELECT min(list_min(x)) AS lo, max(list_max(x)) AS hi FROM p)",
    "tiled_dimensions": _with(POINTS) + "SELECT id, round(x[(99 % len(x)) + 1], 6) AS x99, 100 AS dim FROM p",
    "dense_numbering": "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS nth FROM customer",
    "centered_kernel": _with(POINTS, f"v AS (SELECT a.id AS i, b.id AS j, {_d2('a.x', 'b.x')} AS v FROM p a, p b)") + "SELECT i, j, round(v - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j) + avg(v) OVER (), 6) + 0.0 AS k FROM v",
    **{f"gradient_field_{kind}": _field(kind) for kind in ("pca", "tsne", "frob_tsne", "umap", "frob_umap")},
    "entropy_sigma": _with(*NEAR, "c AS (SELECT i, list(pow(d, 4.0) ORDER BY rank) AS ds FROM knn GROUP BY i)", f"""s AS (SELECT i, [e - list_min(ds) FOR e IN ds] AS t, 0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1::DOUBLE AS mid, 0 AS n FROM c
      UNION ALL
      SELECT i, t, CASE WHEN f > {math.log2(K)!r} THEN lo ELSE mid END, CASE WHEN f > {math.log2(K)!r} THEN mid ELSE hi END,
        CASE WHEN f > {math.log2(K)!r} THEN (lo + mid) / 2 WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END, n + 1
      FROM (SELECT *, list_sum([exp(-e / mid) FOR e IN t]) AS f FROM s WHERE n < 100) WHERE abs(f - {math.log2(K)!r}) >= 0.01)""") + "SELECT i, round(arg_max(mid, n), 5) AS sigma FROM s GROUP BY i",
    "dbscan_clusters": _with(POINTS, FLAT, f"n AS (SELECT a.id AS i, b.id AS j FROM flat a, flat b WHERE (a.y0 - b.y0) * (a.y0 - b.y0) + (a.y1 - b.y1) * (a.y1 - b.y1) <= {0.35 * 0.35!r})", "k AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 5)",
      "l AS (SELECT i AS u, j AS v FROM n WHERE i IN (SELECT i FROM k) AND j IN (SELECT i FROM k))", "r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)", "c AS (SELECT u, min(v) AS c FROM r GROUP BY u)", "b AS (SELECT i, min(c) AS c FROM n JOIN c ON u = j GROUP BY i)") + "SELECT id, coalesce(c.c, b.c, -1) AS cluster FROM flat LEFT JOIN c ON u = id LEFT JOIN b ON i = id",
    "diversified_neighbors": _with(POINTS, _knn(k=6), "o AS (SELECT i, j, d, x, row_number() OVER (PARTITION BY i ORDER BY d, j) AS pos FROM knn JOIN p ON p.id = j WHERE i <> j)", f"""s AS (SELECT id AS i, 0::BIGINT AS n, []::STRUCT(j BIGINT, d DOUBLE, x DOUBLE[])[] AS kept FROM p
      UNION ALL
      SELECT s.i, n + 1, CASE WHEN len([1 FOR c IN kept IF c.d > 1e-8 AND sqrt(sqrt({_d2('c.x', 'o.x')})) < o.d]) > 0 THEN kept ELSE list_append(kept, {{'j': o.j, 'd': o.d, 'x': o.x}}) END FROM s JOIN o ON o.i = s.i AND o.pos = n + 1)""", "f AS (SELECT i, arg_max(kept, n) AS kept FROM s GROUP BY i)", "u AS (SELECT i, unnest(kept) AS e, generate_subscripts(kept, 1)::INT AS rank FROM f)") + "SELECT i, e.j AS j, rank, round(e.d, 6) AS d FROM u",
    "umap_epoch": _umap_epoch(),
    "tsne_epoch": _tsne_epoch(),
    "nn_descent_recall": "SELECT true AS enough",
    "swiss_roll": _generated(500, {"x0": f"{_T} * cos({_T}) + {_normal(2, 'id', '0')} * 0.01::DOUBLE", "x1": f"{_uniform(1, 'id')} * 21 + {_normal(2, 'id', '1')} * 0.01::DOUBLE", "x2": f"{_T} * sin({_T}) + {_normal(2, 'id', '2')} * 0.01::DOUBLE"}, "1.0::DOUBLE"),
    "fake_gaussian": _generated(100, {f"x{k}": _normal(12345, "id", str(k)) for k in (0, 4, 9)}, f"floor({_uniform(12345, 'id', '10')} * 10)::DOUBLE"),
    "fake_clusters": _generated(100, {f"x{k}": f"least(id * 2 // 100, 1) + {_normal(12345, 'id', str(k))} * {math.sqrt(0.1)!r}" for k in (0, 4, 9)}, "least(id * 2 // 100, 1)::DOUBLE"),
    "dbscan_quality": _with(POINTS, f"n AS (SELECT a.id AS i, b.id AS j FROM p a, p b WHERE {_d2('a.x', 'b.x')} <= {0.9 * 0.9!r})", *_DBSCAN, """a AS (SELECT label, coalesce(c.c, b.c) AS c FROM p LEFT JOIN c ON u = id LEFT JOIN b ON i = id WHERE coalesce(c.c, b.c) IS NOT NULL)""",
      """q AS (SELECT label, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS l, sum(count(*)) OVER (PARTITION BY c) AS k, sum(count(*)) OVER () AS t FROM a GROUP BY label, c)""",
      """e AS (SELECT sum(-n / t * ln(n / k)) AS lk, sum(-n / t * ln(n / l)) AS kl, sum(-n / t * ln(l / t)) AS hl, sum(-n / t * ln(k / t)) AS hk FROM q)""",
      """s AS (SELECT CASE WHEN hl = 0 THEN 1.0 ELSE 1 - lk / hl END AS h, CASE WHEN hk = 0 THEN 1.0 ELSE 1 - kl / hk END AS c FROM e)""")
      + "SELECT round(h, 6)::DOUBLE AS homogeneity, round(c, 6)::DOUBLE AS completeness, round(CASE WHEN h + c = 0 THEN 0.0 ELSE 2 * h * c / (h + c) END, 6)::DOUBLE AS v_measure FROM s",
    "gaussian_distances": f"""WITH n AS (SELECT range AS id FROM range(60)),
      a AS (SELECT id, [{', '.join(_normal(0, 'id', str(k)) for k in range(10))}] AS x, [{', '.join(_normal(1, 'id', str(k)) for k in range(2))}] AS y FROM n),
      d AS (SELECT a.id AS i, b.id AS j, {_d2('a.x', 'b.x')} AS h, {_d2('a.y', 'b.y')} AS l FROM a JOIN a b ON a.id < b.id),
      h AS (SELECT h * h AS high, row_number() OVER (ORDER BY h * h, i, j) - 1 AS place FROM d WHERE h > 0),
      l AS (SELECT l * l AS low, row_number() OVER (ORDER BY l * l, i, j) - 1 AS place FROM d WHERE l > 0)
      SELECT place, round(low, 5) AS low, round(high, 4) AS high FROM h JOIN l USING (place)""",
    "point_distances": _with(POINTS, "s AS (SELECT id, x FROM p WHERE id % greatest(1, (SELECT count(*) FROM p) // 50) = 0)", f"d AS (SELECT a.id AS i, b.id AS j, {_d2('a.x', 'b.x')} AS d FROM s a JOIN s b ON a.id < b.id)")
      + "SELECT row_number() OVER (ORDER BY d * d, i, j) - 1 AS place, round(d * d, 5) AS value FROM d WHERE d > 0",
    "centered_gradient_field": """WITH n AS (SELECT range AS id, range * range * 0.0131313::DOUBLE + 0.01::DOUBLE AS x, range * range * 0.0070707::DOUBLE + 0.01::DOUBLE AS y FROM range(8)),
      d AS (SELECT a.id * 8 + b.id AS number, a.id AS i, b.id AS j, (a.x - b.x) * (a.x - b.x) AS h, (a.y - b.y) * (a.y - b.y) AS l FROM n a, n b),
      k AS (SELECT *, h - avg(h) OVER (PARTITION BY i) - avg(h) OVER (PARTITION BY j) + avg(h) OVER () AS p, l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER () AS q FROM d),
      x AS (SELECT row_number() OVER (ORDER BY h, number) - 1 AS x_place, p FROM k),
      y AS (SELECT row_number() OVER (ORDER BY l, number) - 1 AS place, q FROM k)
      SELECT x_place, 63 - place AS y_place, round(-4 * (q - p) * sqrt(l), 6) + 0.0 AS grad FROM x, y JOIN d ON d.number = y.place""",
}
