"""Budgeted caches and request streams, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as K
from ..operators import catalog as C
from ..operators import requests as Q
from ..sources import fixtures as X
from .fixtures_sql import CACHEF, REQ

REST_MS = 4 * 3600 * 1000


def make_room(spark, sf):
    return K.make_room(X.cache_files(spark, sf), 10_000_000, 3_000_000_000, 5_000_000, 1_000_000)


def named_class(spark, sf):
    name = F.concat(F.lpad(F.lower(F.hex(F.col("o_orderkey") * 7919)), 16, "0"), F.element_at(F.array(*map(F.lit, (".tiles", ".tiles.part", ".tile", ".TILES", ""))), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return X.table(spark, sf, "orders").select("o_orderkey", K.classify_name(name).alias("class"))


def _stored(spark, sf):
    files = X.table(spark, sf, "orders")
    kind = (F.col("o_orderkey") % 3).cast("int")
    return files.select(
        (F.col("o_custkey") % 500).alias("identity"),
        F.concat((F.col("o_custkey") % 500).cast("string"), F.lit("|"), F.element_at(F.array(*map(F.lit, ("exact", "pq", "sdr"))), kind + 1)).alias("name"),
        (F.col("o_orderkey") % 4).cast("int").alias("place"),
        (kind < 2).alias("pq"),
    ).where("identity % 5 <> 0 or not pq")


def _candidates(hdr):
    def query(spark, sf):
        wanted = spark.range(500).select(F.col("id").alias("identity"), F.concat(F.col("id").cast("string"), F.lit("|exact")).alias("exact"))
        return K.best_candidate(wanted, _stored(spark, sf), hdr)

    return query


_STORED = """st AS (SELECT * FROM (SELECT o_custkey % 500 AS identity, (o_custkey % 500) || '|' || (['exact', 'pq', 'sdr'])[o_orderkey % 3 + 1] AS name,
  (o_orderkey % 4)::INT AS place, o_orderkey % 3 < 2 AS pq FROM orders) WHERE identity % 5 <> 0 OR NOT pq)"""


def _candidates_sql(hdr):
    rule = "CASE WHEN name LIKE '%exact' THEN 0 WHEN pq THEN 1 ELSE 2 END" if hdr else "CASE WHEN name LIKE '%exact' THEN 0 END"
    return f"""WITH {_STORED}, r AS (SELECT *, {rule} AS turn FROM st)
    SELECT identity, name, place, turn > 0 AS stale FROM r WHERE turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identity ORDER BY turn, place, name) = 1"""


def _entries(spark, sf):
    """A cache for each user: an entry for each file asked for, with its rank around the last request."""
    req = X.requests(spark, sf)
    now = Q.latest_wins(req).select("session", F.col("idx").alias("current"))
    used = req.groupBy("session", "idx", "count").agg(F.max("generation").alias("used"))
    ranked = used.join(now, "session").withColumn("rank", C.window_rank(F.col("idx"), F.col("current"), F.col("count")))
    return ranked.select("session", "idx", "rank", F.col("used").cast("long").alias("used"), (F.col("idx") * 1000 + 1).cast("long").alias("bytes"))


_ENTRIES = f"""{REQ}, now AS (SELECT session, arg_max(idx, generation) AS cur FROM req GROUP BY session),
used AS (SELECT session, idx, max(generation)::BIGINT AS used FROM req GROUP BY ALL),
entries AS (SELECT session, idx, used, (idx * 1000 + 1)::BIGINT AS bytes, CASE WHEN off = 0 THEN 0 WHEN off <= 6 THEN off WHEN 50 - off <= 2 THEN 56 - off ELSE 1048576 END::INT AS rank
  FROM (SELECT u.*, (u.idx - n.cur + 50) % 50 AS off FROM used u JOIN now n USING (session)))"""


def outside_evict(spark, sf):
    return K.outside_evict(_entries(spark, sf), 6, 2)


def victim(spark, sf):
    return K.victim(_entries(spark, sf))


def _jobs(spark, sf):
    return _entries(spark, sf).select("session", "idx", Q.turn(F.col("rank"), 6, 2).alias("turn"), F.col("bytes").alias("estimate"), (F.col("rank") == 0).alias("current")).where("turn < 1048576")


def admit(spark, sf):
    return K.admit(_jobs(spark, sf), 60_000)


_JOBS = f"""{_ENTRIES}, jobs AS (SELECT session, idx, CASE WHEN rank = 0 THEN 0 WHEN rank = 1 THEN 1 WHEN rank = 7 THEN 2 ELSE rank + 1 END::INT AS turn, bytes AS estimate, rank = 0 AS current
  FROM entries WHERE rank < 1048576)"""


def next_job(spark, sf):
    """The first file in turn that needs work."""
    files = _jobs(spark, sf).withColumn("job", F.when(F.col("idx") % 3 == 0, "none").when(F.col("idx") % 7 == 1, "later").otherwise("preview"))
    return Q.pick(files)


def cancel_strays(spark, sf):
    jobs = _entries(spark, sf).select("session", "idx", "rank", F.element_at(F.array(F.lit("preview"), F.lit("whole"), F.lit("frames")), F.col("idx") % 3 + 1).alias("kind"))
    return Q.cancel(jobs)


def cache_totals(spark, sf):
    return _entries(spark, sf).groupBy("session").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


_FLAGS = ("running", "cached", "streamed", "error", "whole", "scalable", "has_frames", "has_tiles", "hdr", "display", "rested")


def wants_job(spark, sf):
    """The truth table over orders: flags from the bits of the key's hash, ranks 0 to 3, 1 or 2 frames."""
    bits = F.col("o_orderkey") * 2654435761 % 4294967296
    e = {n: F.shiftright(bits, 8 + k).bitwiseAND(F.lit(1).cast("long")) == 1 for k, n in enumerate(_FLAGS)}
    e |= {"rank": (F.col("o_orderkey") % 4).cast("int"), "n_frames": (F.shiftright(bits, 20).bitwiseAND(F.lit(1).cast("long")) + 1).cast("int")}
    return X.table(spark, sf, "orders").select("o_orderkey", Q.wants_job(e).alias("job"))


_BITS = "(o_orderkey * 2654435761 % 4294967296)"
_WANTS = f"""WITH f AS (SELECT o_orderkey, o_orderkey % 4 AS rank, (({_BITS} >> 20) & 1) + 1 AS n_frames, {", ".join(f"({_BITS} >> {8 + k}) & 1 = 1 AS {n}" for k, n in enumerate(_FLAGS))} FROM orders)
SELECT o_orderkey, CASE WHEN running THEN 'none' WHEN NOT cached THEN 'preview'
  WHEN streamed AND rank = 0 AND NOT has_tiles AND NOT error AND (NOT hdr OR display) THEN 'preview' WHEN streamed THEN 'none'
  WHEN error OR rank > 1 THEN 'none'
  WHEN (whole OR scalable) AND NOT (rank = 0 AND n_frames > 1 AND NOT has_frames) THEN 'none'
  WHEN NOT rested THEN 'later' WHEN whole THEN 'frames' ELSE 'whole' END AS job FROM f"""


def _bit(k):
    return F.shiftright(F.col("o_orderkey"), k).bitwiseAND(F.lit(1).cast("long")) == 1


def streams(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", Q.streams((F.col("o_orderkey") % 3).cast("int"), _bit(2), _bit(3), F.col("o_totalprice"), 200_000).alias("streams"))


def store_choice(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", Q.store_choice(*[_bit(k) for k in range(7)]).alias("s"))
    return orders.select("o_orderkey", "s.disk", "s.small")


def latest_wins(spark, sf):
    return Q.latest_wins(X.requests(spark, sf))


def generation_filter(spark, sf):
    req = X.requests(spark, sf)
    results = req.select("session", (F.col("generation") + F.col("idx") % 3).alias("generation"), "idx", "ts")
    return Q.current_only(results, req)


def debounce(spark, sf):
    return Q.debounce(X.requests(spark, sf), REST_MS)


def flash(spark, sf):
    req = X.requests(spark, sf)
    asked = req.where("generation % 5 = 0").select("session", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return Q.flashing(req.select("session", "ts"), asked, 2 * 3600 * 1000)


def stale_caches(spark, sf):
    """Hits that are not exact, less those whose levels would come from the source."""
    return _candidates(True)(spark, sf).where("stale and identity % 4 <> 0")


QUERIES = {
    "make_room": (
        make_room,
        f"""WITH {CACHEF}, c AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY folder ORDER BY mtime, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed,
          (sum(bytes) OVER (PARTITION BY folder))::BIGINT AS total FROM cachef)
        SELECT folder, file, mtime, bytes, total - freed + 10000000 > 3000000000 OR freed + 5000000 < 11000000 AS deleted FROM c""",
    ),
    "named_class": (named_class, "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'finished' WHEN 1 THEN 'unfinished' ELSE 'foreign' END AS class FROM orders"),
    "cache_candidates": (_candidates(True), _candidates_sql(True)),
    "cache_candidates_sdr": (_candidates(False), _candidates_sql(False)),
    "stale": (stale_caches, f"SELECT * FROM ({_candidates_sql(True)}) WHERE stale AND identity % 4 <> 0"),
    "outside_evict": (
        outside_evict,
        f"WITH {_ENTRIES} SELECT session, idx, rank, used, bytes FROM entries WHERE rank = 1048576 QUALIFY row_number() OVER (PARTITION BY session ORDER BY used DESC, idx) > 4",
    ),
    "victim": (victim, f"WITH {_ENTRIES} SELECT session, idx, rank FROM entries WHERE rank > 1 QUALIFY row_number() OVER (PARTITION BY session ORDER BY rank DESC, used, idx) = 1"),
    "admit": (
        admit,
        f"""WITH {_JOBS} SELECT session, idx, turn, estimate, current,
        current OR coalesce(sum(estimate) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) <= 60000 AS go FROM jobs""",
    ),
    "next_job": (next_job, f"WITH {_JOBS} SELECT session, idx, 'preview' AS job, turn FROM jobs WHERE idx % 3 <> 0 AND idx % 7 <> 1 QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn) = 1"),
    "cancel_strays": (
        cancel_strays,
        f"WITH {_ENTRIES}, j AS (SELECT session, idx, rank, (['preview', 'whole', 'frames'])[idx % 3 + 1] AS kind FROM entries) SELECT * FROM j WHERE rank = 1048576 OR (kind = 'whole' AND rank > 1) OR (kind = 'frames' AND rank > 0)",
    ),
    "cache_totals": (cache_totals, f"WITH {_ENTRIES} SELECT session, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM entries GROUP BY 1"),
    "wants_job": (wants_job, _WANTS),
    "streams": (streams, "SELECT o_orderkey, o_orderkey % 3 <= 1 AND ((o_orderkey >> 2) & 1 = 1 OR (o_orderkey >> 3) & 1 = 1 OR o_totalprice > 200000) AS streams FROM orders"),
    "store_choice": (
        store_choice,
        f"""WITH f AS (SELECT o_orderkey, {", ".join(f"(o_orderkey >> {k}) & 1 = 1 AS {n}" for k, n in enumerate(("footprint", "all_", "rebuild", "had", "persist", "huge", "small_")))} FROM orders),
        d AS (SELECT *, (NOT footprint OR all_) AND (rebuild AND had OR persist OR huge) AS disk FROM f) SELECT o_orderkey, disk, small_ OR (footprint AND NOT disk) AS small FROM d""",
    ),
    "latest_wins": (latest_wins, f"WITH {REQ} SELECT session, generation::INT AS generation, ts, idx FROM req QUALIFY row_number() OVER (PARTITION BY session ORDER BY generation DESC) = 1"),
    "generation_filter": (
        generation_filter,
        f"WITH {REQ}, m AS (SELECT session, max(generation) AS top FROM req GROUP BY 1) SELECT session, generation + idx % 3 AS generation, idx, ts FROM req JOIN m USING (session) WHERE generation + idx % 3 = top",
    ),
    "debounce": (
        debounce,
        f"""WITH {REQ}, g AS (SELECT *, lead(ts) OVER (PARTITION BY session ORDER BY ts, generation) AS nxt FROM req)
        SELECT session, generation, ts, idx, count FROM g WHERE nxt IS NULL OR nxt - ts >= INTERVAL 4 HOUR""",
    ),
    "flash": (
        flash,
        f"""WITH {REQ}, q AS (SELECT session, ts + INTERVAL 1 HOUR AS t FROM req WHERE generation % 5 = 0),
        l AS (SELECT q.session, q.t, max(r.ts) AS last FROM q JOIN req r ON r.session = q.session AND r.ts <= q.t GROUP BY ALL)
        SELECT session, t AS "at", epoch_ms(t) - epoch_ms(last) < 7200000 AS flashing FROM l""",
    ),
}
