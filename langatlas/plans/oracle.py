"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code, in long form (joins over the
language rows instead of in-row arrays).  The bridge CTEs mirror
``langatlas.sources.bridge``.
"""

from __future__ import annotations

from langatlas.plans import oracle_clusters as OC

BRIDGE = """
li_lang AS (
  SELECT l_orderkey AS repo_id, concat(p_brand, '/', p_type) AS lang, l_quantity, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
langs AS (
  SELECT repo_id, lang, CAST(sum(l_quantity) AS BIGINT) AS loc,
         row_number() OVER (PARTITION BY repo_id ORDER BY min(l_linenumber), lang) AS ordinal
  FROM li_lang WHERE lang IS NOT NULL AND lang <> 'message'
  GROUP BY repo_id, lang
),
owner AS (
  SELECT c_custkey AS owner_id, 'user-' || CAST(c_custkey AS VARCHAR) AS login,
         c_mktsegment AS type, c_acctbal,
         CASE WHEN c_custkey % 17 = 0 THEN NULL
              WHEN c_custkey % 19 = 0 THEN 'Worldwide'
              WHEN c_custkey % 23 = 0 THEN 'the internet'
              WHEN c_custkey % 29 = 0 THEN 'Somewhere'
              WHEN c_custkey % 31 = 0 THEN 'me@home'
              ELSE n_name END AS location,
         CAST(coalesce(cnt.cnt, 0) AS BIGINT) AS repos,
         CAST(floor(c_acctbal / 100) AS BIGINT) AS followers
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) cnt
    ON cnt.o_custkey = c_custkey
),
repo AS (
  SELECT o_orderkey AS id, o_orderdate,
         CASE WHEN ow.owner_id IS NULL THEN '' ELSE ow.location END AS location,
         coalesce(ow.repos, 0) AS repos, coalesce(ow.followers, 0) AS followers
  FROM orders LEFT JOIN owner ow ON ow.owner_id = o_custkey
),
repo_stats AS (
  SELECT repo_id, count(*) AS n_langs, sum(loc) AS tot FROM langs GROUP BY repo_id
),
geo AS (
  SELECT n_name AS location, r_name AS city, n_name AS country, n_regionkey, n_nationkey,
         CASE WHEN n_nationkey % 12 = 11 THEN NULL
              ELSE CAST((n_nationkey * 37) % 120 - 60 AS DOUBLE) END AS lat,
         CASE WHEN n_nationkey % 12 = 11 THEN NULL
              ELSE CAST((n_nationkey * 71) % 300 - 150 AS DOUBLE) END AS lng
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
),
known_geo AS (SELECT * FROM geo WHERE n_regionkey < 2),
e1 AS (
  SELECT l.lang, r.location, CAST(sum(l.loc) AS BIGINT) AS loc
  FROM langs l JOIN repo r ON r.id = l.repo_id JOIN repo_stats s ON s.repo_id = l.repo_id
  WHERE s.tot >= 200 AND r.repos > 1 AND r.followers >= 10
  GROUP BY l.lang, r.location
),
clean AS (
  SELECT * FROM e1
  WHERE lang <> 'message' AND location IS NOT NULL
    AND lower(location) NOT IN ('undefined', 'null', '0', '1', 'earth',
                                'the internet', 'the interweb', 'worldwide')
    AND length(location) <= 48 AND loc IS NOT NULL
),
density AS (
  SELECT e1.lang, e1.location, g.lat, g.lng, e1.loc AS density
  FROM e1 JOIN geo g ON g.location = e1.location
  WHERE g.lat IS NOT NULL AND g.lng IS NOT NULL
),
universe AS (
  SELECT lat, lng, CAST(sum(density) AS BIGINT) AS total
  FROM density WHERE density > 0 GROUP BY lat, lng
),
bin_idx AS (
  SELECT lat, lng, CAST(row_number() OVER (ORDER BY lat, lng) - 1 AS BIGINT) AS bin FROM universe
),
bins AS (
  SELECT d.lang, b.bin, d.value FROM (
    SELECT lang, lat, lng, CAST(sum(density) AS BIGINT) AS value
    FROM density WHERE density > 0 GROUP BY lang, lat, lng) d
  JOIN bin_idx b ON b.lat = d.lat AND b.lng = d.lng
),
energy AS (
  SELECT lang, bin, value, before, energy FROM (
    SELECT lang, bin, value,
           coalesce(sum(CAST(value AS HUGEINT) * value) OVER (
             PARTITION BY lang ORDER BY value DESC, bin ASC
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(CAST(value AS HUGEINT) * value) OVER (PARTITION BY lang) AS energy
    FROM bins)
  WHERE before * 10000 < 4356 * energy
),
pairs AS (
  SELECT a.lang AS base, b.lang AS other, count(*) AS n
  FROM langs a JOIN langs b ON a.repo_id = b.repo_id AND a.lang <> b.lang
  GROUP BY a.lang, b.lang
),
totals AS (
  SELECT l.lang, CAST(sum(s.n_langs - 1) AS BIGINT) AS pair_count, count(*) AS repo_count
  FROM langs l JOIN repo_stats s ON s.repo_id = l.repo_id
  WHERE s.n_langs > 1 GROUP BY l.lang
),
partners AS (
  SELECT lang, rank, partner, occ FROM (
    SELECT c.base AS lang, c.partner, c.occ,
           CAST(row_number() OVER (PARTITION BY c.base
                ORDER BY c.occ DESC, (c.partner = c.base) DESC, c.partner ASC) AS BIGINT) AS rank
    FROM (
      SELECT p.base, p.other AS partner, CAST(p.n AS DOUBLE) / t.pair_count AS occ
      FROM pairs p JOIN totals t ON t.lang = p.base
      UNION ALL
      SELECT t.lang, t.lang, CAST(t.pair_count AS DOUBLE) / t.pair_count FROM totals t
    ) c WHERE c.occ IS NOT NULL AND c.occ <> 0 AND NOT isnan(c.occ))
  WHERE rank <= 3
),
top_langs AS (
  SELECT lang, pair_count, repo_count FROM totals ORDER BY pair_count DESC, lang LIMIT 35
),
report AS (
  SELECT t.lang, t.pair_count, t.repo_count, p.rank, p.partner, p.occ
  FROM top_langs t JOIN partners p ON p.lang = t.lang
),
prim AS (
  SELECT repo_id, lang AS src, loc AS src_loc FROM (
    SELECT repo_id, lang, loc,
           row_number() OVER (PARTITION BY repo_id ORDER BY loc DESC, ordinal) AS rn
    FROM langs) WHERE rn = 1
),
emissions AS (
  SELECT p.repo_id, p.src, p.src_loc, l.lang AS dst,
         CASE WHEN s.tot = 0 THEN NULL ELSE CAST(l.loc AS DOUBLE) / s.tot END AS w
  FROM prim p JOIN langs l ON l.repo_id = p.repo_id AND l.lang <> p.src
  JOIN repo_stats s ON s.repo_id = p.repo_id
),
edges AS (
  SELECT src, dst, count(*) AS n, CAST(sum(src_loc) AS BIGINT) AS loc, avg(w) AS weight,
         sum(w) AS sum_w, coalesce(stddev_pop(w), 0) AS std_w
  FROM emissions GROUP BY src, dst
),
nodes AS (
  SELECT p.src AS lang, CAST(sum(p.src_loc * (s.n_langs - 1)) AS BIGINT) AS loc,
         CAST(sum(p.src_loc) AS BIGINT) AS loc_repo, count(*) AS n_repos
  FROM prim p JOIN repo_stats s ON s.repo_id = p.repo_id
  WHERE s.n_langs > 1 GROUP BY p.src
  HAVING sum(p.src_loc * (s.n_langs - 1)) > 5000
),
candidates AS (SELECT DISTINCT location FROM repo WHERE location IS NOT NULL),
geocodable AS (
  SELECT location FROM candidates
  WHERE location <> '' AND length(location) BETWEEN 3 AND 10
    AND lower(location) NOT IN ('undefined', 'null', '0', '1', 'earth',
                                'the internet', 'the interweb', 'worldwide')
    AND NOT contains(location, '@') AND NOT contains(lower(location), 'where')
),
pending AS (
  SELECT location FROM geocodable WHERE location NOT IN (SELECT location FROM known_geo)
),
replies AS (
  SELECT c.location,
         CASE WHEN g.location IS NULL THEN NULL
              WHEN g.lat IS NOT NULL THEN 'OK' ELSE 'ZERO_RESULTS' END AS status,
         CASE WHEN g.lat IS NOT NULL THEN g.city END AS city,
         CASE WHEN g.lat IS NOT NULL AND g.n_nationkey % 5 <> 2 THEN g.country END AS country,
         g.lat, g.lng,
         CASE WHEN g.location IS NULL AND length(c.location) % 2 = 0 THEN 'malformed'
              WHEN g.location IS NULL THEN 'transport'
              WHEN g.lat IS NULL THEN 'refused' END AS fault
  FROM candidates c LEFT JOIN geo g ON g.location = c.location
)
"""


def _q(body: str) -> str:
    return "WITH " + BRIDGE.strip() + "\n" + body.strip()


def r6(x: str) -> str:
    """Same engine-stable half-up rounding as ``functions.scalars.stable_round6``."""
    return f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"


ORACLE: dict[str, str] = {
    "lang_region_loc": "SELECT lang, location, loc FROM e1",
    "sink_overwrite": "SELECT lang, location, loc FROM e1",
    "incremental_ingest": """
        SELECT event_id, ts, user_id, event_type, value, props FROM (
          SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM events)
        WHERE rn = 1""",
    "lang_region_kept_up": "SELECT lang, location, loc FROM e1",
    "correlation_kept_up": """
        SELECT p.base, p.other, p.n, t.pair_count, t.repo_count
        FROM pairs p JOIN totals t ON t.lang = p.base""",
    "graph_edges_kept_up": f"""
        SELECT src, dst, count(*) AS n, CAST(sum(src_loc) AS BIGINT) AS loc,
               {r6("CAST(sum(CAST(round(w * 1099511627776.0) AS BIGINT)) AS DOUBLE)"
                   " / 1099511627776.0 / count(*)")} AS weight
        FROM emissions GROUP BY src, dst""",
    "region_counts": "SELECT location, count(*) AS n FROM repo GROUP BY location",
    "clean_regions": "SELECT lang, location, loc FROM clean",
    "lang_top_regions": """
        SELECT lang, location, loc,
               CAST(row_number() OVER (PARTITION BY lang ORDER BY loc DESC, location ASC) AS BIGINT)
                 AS rank
        FROM clean""",
    "lang_density": "SELECT lang, location, lat, lng, density FROM density",
    "listed_languages": """
        SELECT lang FROM e1 WHERE location IS NOT NULL GROUP BY lang HAVING sum(loc) > 0""",
    "heatmap_points": """
        SELECT lat, lng, density AS weight FROM density
        WHERE lang = (SELECT lang FROM density GROUP BY lang
                      ORDER BY sum(density) DESC, lang LIMIT 1)""",
    "lang_total_label": """
        SELECT lang, total,
               CASE WHEN total > 10000
                    THEN CAST(CAST(floor(total / 1000) AS BIGINT) AS VARCHAR) || 'K LoC'
                    ELSE CAST(total AS VARCHAR) || ' LoC' END AS label
        FROM (SELECT lang, CAST(sum(density) AS BIGINT) AS total FROM density GROUP BY lang)""",
    "doc_lang_source": """
        SELECT lang, source AS location, CAST(sum(n_chars) AS BIGINT) AS loc
        FROM documents GROUP BY lang, source""",
    "doc_top_sources": """
        SELECT lang, location, loc,
               CAST(row_number() OVER (PARTITION BY lang ORDER BY loc DESC, location ASC) AS BIGINT)
                 AS rank
        FROM (SELECT lang, source AS location, CAST(sum(n_chars) AS BIGINT) AS loc
              FROM documents GROUP BY lang, source)
        WHERE lang <> 'message' AND location IS NOT NULL
          AND lower(location) NOT IN ('undefined', 'null', '0', '1', 'earth',
                                      'the internet', 'the interweb', 'worldwide')
          AND length(location) <= 48 AND loc IS NOT NULL""",
    "lang_coords": """
        SELECT e1.lang, e1.location, g.lat, g.lng, e1.loc
        FROM e1 LEFT JOIN (SELECT * FROM geo WHERE lat IS NOT NULL AND lng IS NOT NULL) g
          ON g.location = e1.location""",
    "sink_json": """
        SELECT lang, coalesce(location, 'null') AS location, CAST(sum(loc) AS BIGINT) AS loc
        FROM e1 GROUP BY lang, coalesce(location, 'null')""",
    "scan_dist": """
        SELECT lang, lat, lng, density FROM density
        UNION ALL
        SELECT DISTINCT lang, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)
        FROM e1 WHERE lang NOT IN (SELECT lang FROM density)""",
    "listed_languages_export": """
        SELECT lang FROM e1 WHERE location IS NOT NULL GROUP BY lang HAVING sum(loc) > 0""",
    "cluster_vectors": """
        SELECT lang, bin, value FROM (
          SELECT lang, bin,
                 CAST(floor(100.0 * value / sqrt(CAST(energy AS DOUBLE)) + 0.5) AS BIGINT) AS value
          FROM energy) WHERE value <> 0""",
    "corr_json": f"""
        SELECT lang, pair_count, repo_count, rank, partner, {r6('occ')} AS occ FROM report""",
    "graph_emissions": f"""
        SELECT repo_id AS repo, src, src_loc, dst, {r6('w')} AS w FROM emissions""",
    "array_functions": """
        SELECT repo_id,
               string_agg(lang, '|' ORDER BY ordinal) FILTER (WHERE ordinal <= 2) || '|...'
                 AS first_two,
               string_agg(lang, '|' ORDER BY lang) AS names, CAST(sum(loc) AS BIGINT) AS total
        FROM langs JOIN orders ON o_orderkey = repo_id GROUP BY repo_id""",
    "geocodable_locations": "SELECT location FROM geocodable",
    "new_locations": "SELECT location FROM pending",
    "geo_exists": """
        SELECT c.location, (k.location IS NOT NULL) AS known
        FROM candidates c LEFT JOIN (SELECT DISTINCT location FROM known_geo) k
          ON k.location = c.location""",
    "geo_latest": """
        SELECT location, city, country, lat, lng, seq FROM (
          SELECT n_name AS location, s_name AS city, n_name AS country,
                 CAST((s_suppkey * 13) % 120 - 60 AS DOUBLE) AS lat,
                 CAST((s_suppkey * 7) % 300 - 150 AS DOUBLE) AS lng,
                 s_suppkey AS seq,
                 row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey DESC) AS rn
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        WHERE rn = 1""",
    "geocode_parse": "SELECT location, status, city, country, lat, lng, fault FROM replies",
    "geocode_quarantine": """
        SELECT location, fault,
               CASE fault WHEN 'malformed' THEN '{"status": "OK", "results": [{"ge'
                          WHEN 'refused' THEN '{"status":"ZERO_RESULTS","results":[]}' END AS body,
               (SELECT count(*) FROM replies) AS n_replies,
               (SELECT count(*) FROM replies WHERE fault = 'transport') AS n_transport,
               (SELECT count(*) FROM replies WHERE fault = 'malformed') AS n_malformed,
               (SELECT count(*) FROM replies WHERE fault = 'refused') AS n_refused
        FROM replies WHERE fault IS NOT NULL""",
    "geo_upsert": """
        SELECT location, city, country, lat, lng FROM known_geo
        WHERE location NOT IN (SELECT location FROM pending)
        UNION ALL
        SELECT p.location,
               CASE WHEN r.status = 'OK' THEN r.city END,
               CASE WHEN r.status = 'OK' THEN r.country END,
               CASE WHEN r.status = 'OK' THEN r.lat END,
               CASE WHEN r.status = 'OK' THEN r.lng END
        FROM pending p LEFT JOIN replies r ON r.location = p.location""",
    "geo_fill_stream": """
        SELECT location, city, country, lat, lng FROM known_geo
        WHERE location NOT IN (SELECT location FROM pending)
        UNION ALL
        SELECT p.location,
               CASE WHEN r.status = 'OK' THEN r.city END,
               CASE WHEN r.status = 'OK' THEN r.country END,
               CASE WHEN r.status = 'OK' THEN r.lat END,
               CASE WHEN r.status = 'OK' THEN r.lng END
        FROM pending p LEFT JOIN replies r ON r.location = p.location""",
    "list_languages": "SELECT DISTINCT lang FROM e1",
    "spatial_universe": "SELECT lat, lng, total FROM universe",
    "lenient_cast": """
        SELECT lang,
               CASE WHEN density % 11 = 0 THEN NULL ELSE lat END AS lat, lng,
               CASE WHEN density % 7 = 0 THEN 0 ELSE density END AS density,
               (density % 11 = 0) AS rejected
        FROM density""",
    "bin_index": "SELECT lat, lng, bin FROM bin_idx",
    "bin_vectors": "SELECT lang, bin, value FROM bins",
    "energy_bins": """
        SELECT lang, bin, value AS b, round(sqrt(CAST(energy AS DOUBLE)), 6) AS norm,
               CAST(floor(100.0 * value / sqrt(CAST(energy AS DOUBLE)) + 0.5) AS BIGINT) AS value
        FROM energy""",
    "energy_bins_literal": """
        SELECT lang, bin, CAST(9223372036854775807 AS BIGINT) AS value FROM (
          SELECT lang, bin, row_number() OVER (PARTITION BY lang ORDER BY value DESC, bin) AS rn
          FROM bins) WHERE rn = 1""",
    "dataset_profile": """
        SELECT (SELECT count(DISTINCT lang) FROM e1) AS n_langs,
               (SELECT count(DISTINCT lang) FROM density) AS n_langs_with_coords,
               (SELECT count(*) FROM density) AS n_coords,
               (SELECT count(*) FROM universe) AS n_spots,
               (SELECT CAST(sum(total) AS BIGINT) FROM universe) AS total_density""",
    "corr_entries": "SELECT base AS lang, count(*) + 1 AS n_entries FROM pairs GROUP BY base",
    "lang_cooccurrence": "SELECT base, other, n FROM pairs",
    "lang_pair_totals": "SELECT lang, pair_count, repo_count FROM totals",
    "corr_top_partners": f"SELECT lang, rank, partner, {r6('occ')} AS occ FROM partners",
    "corr_top_languages": "SELECT lang, pair_count, repo_count FROM top_langs",
    "corr_report": f"""
        SELECT lang, pair_count, repo_count, rank, partner, {r6('occ')} AS occ FROM report""",
    "corr_display": """
        SELECT lang, rank, partner, printf('%.2f %%', floor(occ * 10000) / 100) AS pct
        FROM report WHERE occ > 1e-4""",
    "primary_language": """
        SELECT p.repo_id, p.src AS primary_lang, p.src_loc AS primary_loc,
               f.lang AS first_lang, f.loc AS first_loc
        FROM prim p JOIN langs f ON f.repo_id = p.repo_id AND f.ordinal = 1""",
    "graph_edges": f"SELECT src, dst, n, loc, {r6('weight')} AS weight FROM edges",
    "graph_edges_literal": f"""
        SELECT src, dst, count(*) AS n, CAST(sum(src_loc) AS BIGINT) AS loc,
               {r6('avg(w)')} AS weight
        FROM (
          SELECT p.lang AS src, p.loc AS src_loc, l.lang AS dst,
                 CASE WHEN s.tot = 0 THEN NULL ELSE CAST(l.loc AS DOUBLE) / s.tot END AS w
          FROM langs p JOIN langs l ON l.repo_id = p.repo_id AND l.lang <> p.lang
          JOIN repo_stats s ON s.repo_id = p.repo_id
          WHERE p.ordinal = 1)
        GROUP BY src, dst""",
    "edge_weight_stats": f"""
        SELECT src, dst, n, {r6('sum_w')} AS sum_w, {r6('weight')} AS mean_w,
               {r6('std_w')} AS std_w FROM edges""",
    "graph_nodes": "SELECT lang, loc, loc_repo, n_repos FROM nodes",
    "graph_node_ids": """
        SELECT lang, bool_or(is_primary) AS is_primary FROM (
          SELECT lang, TRUE AS is_primary FROM nodes
          UNION ALL
          SELECT e.dst, FALSE FROM edges e WHERE e.src IN (SELECT lang FROM nodes))
        GROUP BY lang""",
    "resume_cursor": """
        SELECT CAST(coalesce((SELECT o_orderkey FROM orders
                              ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), 0) AS BIGINT)
               AS cursor""",
    "repos_since": """
        SELECT o_orderkey AS id, 'repo-' || CAST(o_orderkey AS VARCHAR) AS name,
               'user-' || CAST(o_custkey AS VARCHAR) AS owner_login
        FROM orders, (SELECT coalesce((SELECT o_orderkey FROM orders
                                       WHERE o_orderdate < TIMESTAMP '1996-01-01'
                                       ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), 0)
                      AS cursor) c
        WHERE c.cursor = 0 OR o_orderkey > c.cursor
        ORDER BY o_orderkey LIMIT 100""",
    "enrich_repos": """
        SELECT o.o_orderkey AS id,
               u.login, u.type,
               CASE WHEN u.owner_id IS NULL THEN '' ELSE u.location END AS location,
               coalesce(u.repos, 0) AS repos, coalesce(u.followers, 0) AS followers,
               CAST(coalesce(s.n_langs, 0) AS BIGINT) AS n_langs,
               CAST(coalesce(s.tot, 0) AS BIGINT) AS total_loc
        FROM orders o
        LEFT JOIN (SELECT * FROM owner WHERE c_acctbal >= 0) u ON u.owner_id = o.o_custkey
        LEFT JOIN repo_stats s ON s.repo_id = o.o_orderkey""",
    "scalar_functions": f"""
        SELECT owner_id, lower(location) AS loc_lower, CAST(length(location) AS BIGINT) AS loc_len,
               contains(location, '@') AS has_at,
               trim('  ' || location || ' ') AS trimmed,
               lower(location) NOT IN ('undefined', 'null', '0', '1', 'earth',
                                       'the internet', 'the interweb', 'worldwide') AS is_place,
               isnan(c_acctbal) AS bal_nan,
               CAST(floor(c_acctbal) AS BIGINT) AS bal_floor,
               {r6('sqrt(CAST(abs(followers) AS DOUBLE))')} AS followers_sqrt,
               pow(followers, 2) AS followers_sq,
               {r6('CASE WHEN followers = 0 THEN NULL ELSE CAST(repos AS DOUBLE) / followers END')}
                 AS repo_ratio,
               printf('%s: %d repos', login, repos) AS label,
               CASE WHEN followers * 1000 > 10000
                    THEN CAST(CAST(floor(followers * 1000 / 1000) AS BIGINT) AS VARCHAR) || 'K LoC'
                    ELSE CAST(followers * 1000 AS VARCHAR) || ' LoC' END AS size_label
        FROM owner""",
}


ASSIGN = "SELECT id AS lang, kmeans, gmm FROM assigned"
MEMBERS = """
SELECT model, cluster, count(*) AS n, string_agg(id, '|' ORDER BY id) AS langs FROM (
  SELECT 'kmeans' AS model, kmeans AS cluster, id FROM assigned
  UNION ALL SELECT 'gmm', gmm, id FROM assigned)
GROUP BY model, cluster"""
CENTERS = f"SELECT model, cluster, dim AS bin, {r6('value')} AS value FROM centres"
LANGUAGE_CLUSTERS = {
    "cluster_assign": ASSIGN, "cluster_assignments": ASSIGN, "cluster_members": MEMBERS,
    "cluster_member_lists": MEMBERS, "cluster_centers": CENTERS,
    "cluster_center_vectors": CENTERS,
}
EMBEDDING_CLUSTERS = {
    "embedding_assignments": "SELECT id AS vec_id, kmeans, gmm FROM assigned",
    "embedding_clusters": f"""
SELECT s.model, s.cluster, s.n, {r6('t.total')} AS total FROM (
  SELECT model, cluster, count(*) AS n FROM (
    SELECT 'kmeans' AS model, kmeans AS cluster FROM assigned
    UNION ALL SELECT 'gmm', gmm FROM assigned) GROUP BY model, cluster) s
LEFT JOIN (SELECT model, cluster, CAST(sum(CAST(value AS DECIMAL(20, 3))) AS DOUBLE) AS total
           FROM centres GROUP BY model, cluster) t
  ON t.model = s.model AND t.cluster = s.cluster""",
}


def oracle_sql() -> dict[str, str]:
    steps = OC.clusters()
    bridged = f"WITH {BRIDGE.strip()},{OC.LANGUAGE_POINTS}{steps}"
    plain = f"WITH {OC.EMBEDDING_POINTS.strip()}{steps}"
    return ({name: _q(body) for name, body in ORACLE.items()}
            | {name: f"{bridged}\n{body}" for name, body in LANGUAGE_CLUSTERS.items()}
            | {name: f"{plain}\n{body}" for name, body in EMBEDDING_CLUSTERS.items()})
