"""A folder's files: which are listed, their orders, positions, neighbours; texts about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..sources import fixtures as X
from .fixtures_sql import CAT

#: The natural key said again with DuckDB's list functions.
_NATURAL = r"""array_to_string(list_transform(regexp_extract_all(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+|[^0-9]'),
  lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '0' || lpad(length(ltrim(t, '0'))::VARCHAR, 4, '0') || ltrim(t, '0') ELSE t END), '')"""
_ORDER = {
    "az": "nk, path",
    "za": "nk DESC, path DESC",
    "newest": "mtime DESC, nk, path",
    "oldest": "mtime, nk, path",
    "smallest": "length, nk, path",
}


def _folder(order):
    return lambda spark, sf: C.arranged(X.catalog(spark, sf), order).select("folder", "path", "idx", "count")


def _folder_sql(order):
    return f"""WITH {CAT}, k AS (SELECT *, {_NATURAL} AS nk FROM cat)
    SELECT folder, path, (row_number() OVER (PARTITION BY folder ORDER BY {_ORDER[order]}) - 1)::INT AS idx, count(*) OVER (PARTITION BY folder) AS count FROM k"""


_RANKED = f"""{CAT}, k AS (SELECT *, {_NATURAL} AS nk FROM cat),
ranked AS (SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY nk, path) - 1 AS idx, count(*) OVER (PARTITION BY folder) AS n FROM k)"""


def suffix_filter(spark, sf):
    files = X.catalog(spark, sf)
    return C.listed(files).select("folder", "path", C.suffix(F.col("name")).alias("suffix"))


_SHOWN = ", ".join(f"'{s}'" for s in C.SUFFIXES)


def position(spark, sf):
    return C.position(C.arranged(X.catalog(spark, sf), "az")).select("path", "position")


def neighbours(spark, sf):
    return C.neighbours(C.arranged(X.catalog(spark, sf), "az"), -1)


def rank_window(spark, sf):
    files = C.arranged(X.catalog(spark, sf), "az")
    return files.select("folder", "idx", C.window_rank(F.col("idx"), F.col("folder").cast("int") % F.col("count").cast("int"), F.col("count").cast("int")).alias("rank"))


def resort_keeps_current(spark, sf):
    """The file at index 3 by name, and where it stands in each other order."""
    files = X.catalog(spark, sf)
    now = C.arranged(files, "az").where("idx = 3").select("folder", "path")
    out = None
    for order in C.ORDERS:
        part = C.arranged(files, order).join(now, ["folder", "path"], "left_semi").select("folder", F.lit(order).alias("sorted"), "path", "idx", C.next_order(F.lit(order)).alias("next"))
        out = part if out is None else out.unionByName(part)
    return out


def wrap_index(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", (F.floor(F.col("value")).cast("long") - 50).alias("i"))
    return events.select("event_id", C.wrap(F.col("i"), F.lit(7)).alias("wrapped"))


def _sizes(spark, sf):
    orders = X.table(spark, sf, "orders")
    n = F.floor(F.col("o_totalprice")).cast("long") * F.element_at(F.array(*[F.lit(v).cast("long") for v in (0, 1, 137, 30011)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return orders.select("o_orderkey", n.alias("n"))


def human_size(spark, sf):
    return _sizes(spark, sf).select("o_orderkey", T.human_size(F.col("n")).alias("shown"))


# every order; a tie of MB or GB is decided by the double's exact value, as C's %.1f does
_SIZE_SQL = """WITH t AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * ([0, 1, 137, 30011])[o_orderkey % 4 + 1] AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 999500 THEN ((n + 499 + (n // 1000) % 2) // 1000) || ' kB'
  WHEN n < 999950000 THEN printf('%.1f MB', n::DOUBLE / 1e6) ELSE printf('%.1f GB', n::DOUBLE / 1e9) END AS shown FROM t"""


def fitted_text(spark, sf):
    orders = X.table(spark, sf, "orders").withColumn("said", F.concat("o_orderpriority", F.lit(" é "), F.col("o_orderkey").cast("string")))
    return orders.select("o_orderkey", T.fitted_text(F.col("said"), (F.col("o_orderkey") % 200).cast("double"), F.lit(8.0)).alias("shown"))


def failure_text(spark, sf):
    files = X.catalog(spark, sf).select("path", F.when(F.col("length") % 2 == 0, F.concat("path", F.lit(": cannot open"))).otherwise(F.concat(F.lit("in "), "path")).alias("message"))
    return files.select("path", T.failure_text(F.col("message"), F.col("path")).alias("shown"), T.abbreviated(F.col("path"), "/f7").alias("short"), T.expanded(F.lit("~/pictures"), "/home/x").alias("long"))


def details_line(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", T.details(F.col("p_name"), F.col("p_size"), F.col("p_size") + 1, F.lit("PNG"), F.col("p_partkey") % 900).alias("line"))
    return part


def widest_line(spark, sf):
    part = X.table(spark, sf, "part")
    return part.groupBy("p_brand").agg(F.max(F.char_length("p_name")).cast("long").alias("widest"))


def duplicate_names(spark, sf):
    return X.catalog(spark, sf).groupBy("folder", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def corpus_strangers(spark, sf):
    """Files without a golden entry, and entries without a file, by name within a folder."""
    files = X.catalog(spark, sf).select("folder", "name").distinct()
    golden = files.where("folder % 3 <> 0").unionByName(files.where("folder % 3 = 1").withColumn("folder", F.col("folder") + 1000))
    joined = files.withColumn("_f", F.lit(True)).join(golden.withColumn("_g", F.lit(True)), ["folder", "name"], "full_outer")
    return joined.where("_f is null or _g is null").select("folder", "name", F.when(F.col("_f").isNull(), "missing").otherwise("stranger").alias("what"))


QUERIES = {
    **{f"folder_{o}": (_folder(o), _folder_sql(o)) for o in C.ORDERS},
    "suffix_filter": (
        suffix_filter,
        f"WITH {CAT} SELECT folder, path, s AS suffix FROM (SELECT *, lower(regexp_extract(name, '([.][^.]*)$', 1)) AS s FROM cat) WHERE s IN ({_SHOWN})",
    ),
    "position": (position, f"WITH {_RANKED} SELECT path, '[' || (idx + 1) || '/' || n || ']' AS position FROM ranked"),
    "neighbours": (
        neighbours,
        f"""WITH {_RANKED}, s AS (SELECT folder, idx, n, k AS rank, k AS step FROM ranked, range(1, 7) t(k) WHERE k <= n - 1
          UNION ALL SELECT folder, idx, n, 6 + k, -k FROM ranked, range(1, 3) t(k) WHERE k <= n - 7)
        SELECT folder, idx::INT AS idx, rank::INT AS rank, (((idx - step) % n + n) % n)::INT AS neighbour FROM s""",
    ),
    "rank_window": (
        rank_window,
        f"""WITH {_RANKED}, o AS (SELECT folder, idx, n, (idx - folder % n + n) % n AS off FROM ranked)
        SELECT folder, idx::INT AS idx, (CASE WHEN off = 0 THEN 0 WHEN off <= least(6, n - 1) THEN off
          WHEN n - off <= greatest(0, least(2, n - 7)) THEN least(6, n - 1) + n - off ELSE 1048576 END)::INT AS rank FROM o""",
    ),
    "resort_keeps_current": (
        resort_keeps_current,
        f"WITH {_RANKED}, cur AS (SELECT path FROM ranked WHERE idx = 3), "
        + ", ".join(f"o_{o} AS (SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY {_ORDER[o]}) - 1 AS idx FROM k)" for o in C.ORDERS)
        + " "
        + " UNION ALL ".join(f"SELECT folder, '{o}' AS sorted, path, idx::INT AS idx, '{C.ORDERS[(i + 1) % 5]}' AS next FROM o_{o} WHERE path IN (SELECT path FROM cur)" for i, o in enumerate(C.ORDERS)),
    ),
    "wrap_index": (wrap_index, "SELECT event_id, (((floor(value)::BIGINT - 50) % 7 + 7) % 7)::BIGINT AS wrapped FROM events"),
    "human_size": (human_size, _SIZE_SQL),
    "fitted_text": (
        fitted_text,
        """WITH t AS (SELECT o_orderkey, o_orderpriority || ' é ' || o_orderkey AS s, (o_orderkey % 200) // 8 AS room FROM orders)
        SELECT o_orderkey, CASE WHEN length(s) <= room THEN s WHEN room <= 3 THEN left(s, room) ELSE left(s, room - 3) || '...' END AS shown FROM t""",
    ),
    "failure_text": (
        failure_text,
        f"""WITH {CAT} SELECT path, CASE WHEN length % 2 = 0 THEN 'cannot open' ELSE 'in ' || path END AS shown,
        CASE WHEN folder = 7 THEN '~' || substr(path, 4) ELSE path END AS short, '/home/x/pictures' AS long FROM cat""",
    ),
    "details_line": (details_line, "SELECT p_partkey, p_name || '  ' || p_size || ' x ' || (p_size + 1) || '  PNG  ' || (p_partkey % 900) || ' B' AS line FROM part"),
    "widest_line": (widest_line, "SELECT p_brand, max(length(p_name)) AS widest FROM part GROUP BY 1"),
    "duplicate_names": (duplicate_names, f"WITH {CAT} SELECT folder, name, count(*) AS n FROM cat GROUP BY 1, 2 HAVING count(*) > 1"),
    "corpus_strangers": (
        corpus_strangers,
        f"""WITH {CAT} SELECT DISTINCT folder, name, 'stranger' AS what FROM cat WHERE folder % 3 = 0
        UNION ALL SELECT DISTINCT folder + 1000, name, 'missing' FROM cat WHERE folder % 3 = 1""",
    ),
}
