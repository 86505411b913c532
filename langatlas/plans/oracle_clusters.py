"""DuckDB SQL of the clustering: the same steps as ``operators.clusters`` in long
form, one CTE a step.

``points(id, dim, x)`` (whole numbers, no zeros) and ``ids(id)`` are given; the
result CTEs are ``assigned(id, kmeans, gmm)`` and ``centres(model, cluster, dim,
value)``.
"""

from __future__ import annotations

from langatlas.operators.clusters import (CENTRE_UNIT, K, KMEANS_ITERATIONS, MIN_VARIANCE,
                                          MIXTURE_ITERATIONS, SHARE_UNIT)

PI = 3.141592653589793


def _seeds(k: int) -> str:
    steps = ["""
own AS MATERIALIZED (
  SELECT ids.id, CAST(coalesce(sum(x * x), 0) AS BIGINT) AS own
  FROM ids LEFT JOIN points ON points.id = ids.id GROUP BY ids.id
),
seed0 AS MATERIALIZED (SELECT id, own FROM own ORDER BY own DESC, id LIMIT 1)"""]
    for s in range(1, k):
        steps.append(f"""
dot{s} AS MATERIALIZED (
  SELECT p.id, sum(p.x * q.x) AS dot FROM points p
  JOIN (SELECT dim, x FROM points WHERE id = (SELECT id FROM seed{s - 1})) q ON q.dim = p.dim
  GROUP BY p.id
),
to{s} AS MATERIALIZED (
  SELECT o.id, CAST(o.own + (SELECT own FROM seed{s - 1}) - 2 * coalesce(d.dot, 0) AS BIGINT) AS far
  FROM own o LEFT JOIN dot{s} d ON d.id = o.id
),
far{s} AS MATERIALIZED (
  {f"SELECT id, far FROM to{s}" if s == 1 else
   f"SELECT t.id, least(t.far, f.far) AS far FROM to{s} t JOIN far{s - 1} f ON f.id = t.id"}
),
seed{s} AS MATERIALIZED (
  SELECT o.id, o.own FROM far{s} f JOIN own o ON o.id = f.id ORDER BY f.far DESC, o.id LIMIT 1
)""")
    union = " UNION ALL ".join(
        f"SELECT {s} AS cluster, dim, x * {CENTRE_UNIT} AS c FROM points "
        f"WHERE id = (SELECT id FROM seed{s})" for s in range(k))
    steps.append(f"""
c0 AS MATERIALIZED ({union})""")
    return ",".join(steps)


def _near(name: str, centre: str, k: int) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT id, cluster FROM (
    SELECT i.id, r.cluster, row_number() OVER (
             PARTITION BY i.id
             ORDER BY coalesce(n.norm, 0) - {2 * CENTRE_UNIT} * coalesce(d.dot, 0), r.cluster) AS rn
    FROM ids i CROSS JOIN (SELECT CAST(range AS INTEGER) AS cluster FROM range({k})) r
    LEFT JOIN (SELECT cluster, sum(c * c) AS norm FROM {centre} GROUP BY cluster) n
      ON n.cluster = r.cluster
    LEFT JOIN (SELECT p.id, c.cluster, sum(p.x * c.c) AS dot FROM points p
               JOIN {centre} c ON c.dim = p.dim GROUP BY p.id, c.cluster) d
      ON d.id = i.id AND d.cluster = r.cluster)
  WHERE rn = 1
)"""


def _lloyd(k: int, rounds: int) -> str:
    steps = []
    for r in range(1, rounds + 1):
        steps.append(_near(f"a{r}", f"c{r - 1}", k))
        steps.append(f"""
m{r} AS MATERIALIZED (SELECT cluster, count(*) AS m FROM a{r} GROUP BY cluster),
c{r} AS MATERIALIZED (
  SELECT a.cluster, p.dim,
         CAST(floor(CAST({2 * CENTRE_UNIT} * sum(p.x) + m.m AS DOUBLE) / (2 * m.m)) AS BIGINT) AS c
  FROM a{r} a JOIN points p ON p.id = a.id JOIN m{r} m ON m.cluster = a.cluster
  GROUP BY a.cluster, p.dim, m.m
  UNION ALL
  SELECT cluster, dim, c FROM c{r - 1} WHERE cluster NOT IN (SELECT cluster FROM m{r})
)""")
    steps.append(_near("nearest", f"c{rounds}", k))
    return ",".join(steps)


def _mixture(k: int, rounds: int) -> str:
    steps = [f"""
comps AS MATERIALIZED (SELECT CAST(range AS INTEGER) AS cluster FROM range({k})),
dims AS MATERIALIZED (SELECT DISTINCT dim FROM points),
s0 AS MATERIALIZED (
  SELECT n.id, c.cluster, CAST(CASE WHEN c.cluster = n.cluster THEN {SHARE_UNIT} ELSE 0 END AS BIGINT) AS r
  FROM nearest n CROSS JOIN comps c
)"""]
    for r in range(rounds + 1):
        steps.append(f"""
n{r} AS MATERIALIZED (SELECT cluster, CAST(sum(r) AS DOUBLE) AS n FROM s{r} GROUP BY cluster),
w{r} AS MATERIALIZED (
  SELECT cluster, dim, m, CASE WHEN n = 0 THEN {MIN_VARIANCE}
                               ELSE greatest(q / n - m * m, {MIN_VARIANCE}) END AS v
  FROM (SELECT s.cluster, p.dim, n.n, CAST(sum(s.r * p.x * p.x) AS DOUBLE) AS q,
               CASE WHEN n.n = 0 THEN 0.0 ELSE CAST(sum(s.r * p.x) AS DOUBLE) / n.n END AS m
        FROM points p JOIN s{r} s ON s.id = p.id JOIN n{r} n ON n.cluster = s.cluster
        GROUP BY s.cluster, p.dim, n.n)
),
b{r} AS MATERIALIZED (
  SELECT n.cluster, CASE WHEN n.n = 0 THEN CAST('-Infinity' AS DOUBLE)
         ELSE ln(n.n / (SELECT sum(n) FROM n{r})) - 0.5 * coalesce(w.total, 0.0) END AS base
  FROM n{r} n LEFT JOIN (
    SELECT cluster, sum(ln(v * {2.0 * PI!r}) + m * m / v) AS total FROM w{r} GROUP BY cluster) w
    ON w.cluster = n.cluster
),
s{r + 1} AS MATERIALIZED (
  SELECT id, cluster, CAST(floor(e / sum(e) OVER (PARTITION BY id) * {SHARE_UNIT} + 0.5) AS BIGINT) AS r
  FROM (
    SELECT id, cluster, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM (
      SELECT i.id, b.cluster, b.base + coalesce(t.l, 0.0) AS l
      FROM ids i CROSS JOIN b{r} b
      LEFT JOIN (SELECT p.id, w.cluster, sum((p.x * w.m * 2.0 - p.x * p.x) / (w.v * 2.0)) AS l
                 FROM points p JOIN w{r} w ON w.dim = p.dim GROUP BY p.id, w.cluster) t
        ON t.id = i.id AND t.cluster = b.cluster))
)""")
    steps.append(f"""
likeliest AS MATERIALIZED (
  SELECT id, cluster FROM (
    SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY r DESC, cluster) AS rn
    FROM s{rounds + 1}) WHERE rn = 1
)""")
    return ",".join(steps)


def _numbers(name: str, of: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT c.cluster, CAST(row_number() OVER (
           ORDER BY (l.least IS NULL), l.least, c.cluster) - 1 AS INTEGER) AS number
  FROM comps c LEFT JOIN (SELECT cluster, min(id) AS least FROM {of} GROUP BY cluster) l
    ON l.cluster = c.cluster
)"""


def clusters(k: int = K, rounds: int = KMEANS_ITERATIONS,
             mixture_rounds: int = MIXTURE_ITERATIONS) -> str:
    return ",".join([
        _seeds(k), _lloyd(k, rounds), _mixture(k, mixture_rounds),
        _numbers("knum", "nearest"), _numbers("gnum", "likeliest"), f"""
assigned AS MATERIALIZED (
  SELECT n.id, kn.number AS kmeans, gn.number AS gmm
  FROM nearest n JOIN likeliest l ON l.id = n.id
  JOIN knum kn ON kn.cluster = n.cluster JOIN gnum gn ON gn.cluster = l.cluster
),
centres AS MATERIALIZED (
  SELECT 'kmeans' AS model, kn.number AS cluster, dim, c / {float(CENTRE_UNIT)} AS value
  FROM c{rounds} c JOIN knum kn ON kn.cluster = c.cluster WHERE c <> 0
  UNION ALL
  SELECT 'gmm', gn.number, dim, m FROM w{mixture_rounds} w
  JOIN gnum gn ON gn.cluster = w.cluster WHERE m <> 0
)"""])


LANGUAGE_POINTS = """
points AS MATERIALIZED (
  SELECT lang AS id, bin AS dim, x FROM (
    SELECT lang, bin,
           CAST(floor(100.0 * value / sqrt(CAST(energy AS DOUBLE)) + 0.5) AS BIGINT) AS x
    FROM energy) WHERE x <> 0
),
ids AS MATERIALIZED (SELECT DISTINCT lang AS id FROM density),"""

EMBEDDING_POINTS = """
points AS MATERIALIZED (
  SELECT id, dim, x FROM (
    SELECT vec_id AS id, d AS dim,
           CAST(floor(CAST(embedding[d + 1] AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS x
    FROM embeddings, (SELECT CAST(range AS BIGINT) AS d FROM range(64)) r
    WHERE d < len(embedding)) WHERE x <> 0
),
ids AS MATERIALIZED (SELECT DISTINCT vec_id AS id FROM embeddings),"""
