"""The fixtures of ``tilescope.sources.fixtures`` as DuckDB common table expressions."""

PX = """px AS (
  SELECT image, x, y, r, (r * 7 + x) % 256 AS g, (r * 13 + y) % 256 AS b, CASE WHEN x % 16 = 0 THEN 0 ELSE 255 END AS a FROM (
    SELECT image, y, (k - 1)::INT AS x, floor((embedding[k]::DOUBLE + 1) * 127.5)::INT AS r FROM (
      SELECT label AS image, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS y, generate_subscripts(embedding, 1) AS k
      FROM embeddings)))"""

DIM = "dim AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY image)"

GRID = """grid AS (
  SELECT 0 AS image, (i % 61)::INT AS x, (i // 61)::INT AS y, coalesce(v, 0)::INT AS v FROM range(61 * 37) t(i)
  LEFT JOIN (SELECT l_orderkey % 61 AS gx, l_partkey % 37 AS gy, max(trunc(l_quantity * 5)::INT) AS v FROM lineitem GROUP BY 1, 2) ON gx = i % 61 AND gy = i // 61)"""

FR = """fr AS (
  SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS frame,
    CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN NULL ELSE trunc(l_quantity * 2)::INT END AS stated FROM lineitem)"""

CAT = """cat AS (
  SELECT folder, '/f' || folder || '/' || o_orderkey || '/' || name AS path, name, length, mtime FROM (
    SELECT o_orderkey, o_custkey % 40 AS folder,
      (['img', 'IMG', 'scan-0', 'a_'])[o_orderkey % 4 + 1] || (o_orderkey % 997) || (['.jpg', '.PNG', '.txt', '.webp', '.tiff', ''])[o_orderkey % 6 + 1] AS name,
      CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE floor(o_totalprice * 100) END::BIGINT AS length, o_orderdate AS mtime FROM orders))"""

REQ = """req AS (
  SELECT user_id AS session, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS generation, ts,
    (floor(value * 10)::BIGINT % 50)::INT AS idx, 50 AS count FROM events)"""

CACHEF = """cachef AS (
  SELECT o_orderstatus AS folder, o_orderkey AS file, o_orderdate AS mtime, floor(o_totalprice * 1000)::BIGINT AS bytes FROM orders)"""

VIEWS = """views AS (
  SELECT o_orderkey AS view, (o_orderkey * 37 % 3600)::INT AS x, (o_custkey * 53 % 2700)::INT AS y,
    (o_orderkey % 900 + 100)::INT AS w, (o_custkey % 700 + 50)::INT AS h FROM orders)"""

HAVE = """have AS (
  SELECT * FROM (SELECT ((l_linenumber - 1) % 3)::INT AS level, (l_partkey % ceil(16 / power(2, (l_linenumber - 1) % 3))::INT)::INT AS "column",
    (l_suppkey % ceil(12 / power(2, (l_linenumber - 1) % 3))::INT)::INT AS "row", max(trunc(l_extendedprice)::BIGINT) AS bytes, max(l_orderkey) AS used
  FROM lineitem GROUP BY 1, 2, 3) WHERE ("column" * 7 + "row" * 3 + level) % 5 < 3)"""
