"""Animations as timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators import timeline as L
from ..sources import fixtures as X
from .fixtures_sql import FR

_DELAYED = f"{FR}, d AS (SELECT image, frame, CASE WHEN coalesce(stated, 0) <= 10 THEN 100 ELSE stated END::INT AS delay FROM fr)"
_STARTS = f"""{_DELAYED}, s AS (
  SELECT *, (row_number() OVER o - 1)::INT AS number, (sum(delay) OVER o - delay)::BIGINT AS start, (sum(delay) OVER p)::BIGINT AS duration, count(*) OVER p AS n
  FROM d WINDOW o AS (PARTITION BY image ORDER BY frame), p AS (PARTITION BY image))"""


def delayed(spark, sf):
    return X.frames(spark, sf).select("image", "frame", L.frame_delay(F.col("stated")).alias("delay"))


def starts(spark, sf):
    return L.frame_starts(delayed(spark, sf))


def duration(spark, sf):
    return L.durations(delayed(spark, sf))


def _seek(share):
    return lambda spark, sf: L.seek(starts(spark, sf), share)


def advance(spark, sf):
    asked = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.floor(F.col("o_totalprice")).cast("long").alias("at"))
    return S.advance(starts(spark, sf), asked.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 50))))).select("image", F.expr("at div 400 * k + k").alias("at")))


def play_controls(spark, sf):
    """Ticks, toggles, steps and seeks on each animation, a few seconds apart."""
    k = F.col("l_orderkey") + F.col("n")
    what = F.element_at(F.array(*map(F.lit, ("tick", "tick", "toggle", "tick", "seek", "tick", "step", "back"))), (k % 8 + 1).cast("int"))
    lines = X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) * 3).alias("c")).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("c"))))
    return S.play(starts(spark, sf), lines.select(F.col("l_orderkey").alias("image"), F.col("n").alias("seq"), (F.col("n") * 190).alias("at"), what.alias("what"), (k % 11 / 8.0).alias("share")))


#: The player said again as a recursion over each image's events.
_ADVANCE = """WITH RECURSIVE {starts}, tl AS (SELECT image, list(delay ORDER BY number) AS ds, sum(delay)::BIGINT AS run, count(*) AS n FROM s GROUP BY image),
q AS (SELECT o_orderkey AS image, (floor(o_totalprice)::BIGINT // 400 * k + k)::BIGINT AS pos, row_number() OVER (PARTITION BY o_orderkey ORDER BY floor(o_totalprice)::BIGINT // 400 * k + k) AS i FROM orders, (VALUES (1), (2), (3), (50)) v(k)),
-- one row a step: looks at the clock, and in between each frame that falls due
r AS (
  SELECT image, 0 AS i, 0::BIGINT AS pos, 0 AS f, ds[1]::BIGINT AS due, true AS done FROM tl
  UNION ALL
  SELECT r.image, CASE WHEN r.done THEN r.i + 1 ELSE r.i END, coalesce(q.pos, r.pos),
    CASE WHEN r.done THEN r.f ELSE (r.f + 1) % tl.n END::INT,
    CASE WHEN r.done THEN CASE WHEN q.pos - r.due >= tl.run THEN q.pos ELSE r.due END ELSE r.due + tl.ds[(r.f + 1) % tl.n + 1] END::BIGINT,
    CASE WHEN r.done THEN q.pos < r.due ELSE r.pos < r.due + tl.ds[(r.f + 1) % tl.n + 1] END
  FROM r JOIN tl ON tl.image = r.image LEFT JOIN q ON r.done AND q.image = r.image AND q.i = r.i + 1 WHERE NOT r.done OR q.i IS NOT NULL)
SELECT image, pos AS "at", f AS number, due - pos AS "left" FROM r WHERE done AND i > 0"""


def step_wrap(spark, sf):
    s = starts(spark, sf)
    return s.select("image", "number", L.step_frame(F.col("number"), 1, F.col("n")).alias("after"), L.step_frame(F.col("number"), -1, F.col("n")).alias("before"))


def frame_shrink(spark, sf):
    images = X.table(spark, sf, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 13).alias("w"), (F.col("p_size") * 7 + 1).alias("h"), (F.col("p_partkey") % 30 + 1).alias("frames"))
    return L.frame_shrink(images, 200_000)


def animation_bytes(spark, sf):
    line = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * 10).alias("w"), F.lit(20).alias("h"))
    return L.animation_bytes(line)


def play_bar(spark, sf):
    """Where on a bar of 40..440 a click seeks to, and whether it hits."""
    events = X.table(spark, sf, "events").select("event_id", (F.floor(F.col("value")).cast("long") % 500).alias("x"))
    return events.select("event_id", F.col("x").between(40, 440).alias("hit"), F.least(F.greatest((F.col("x") - 40) / 400.0, F.lit(0.0)), F.lit(1.0)).alias("fraction"))


_SEEK = "SELECT image, floor(duration * {f})::BIGINT AS target, max(CASE WHEN start <= floor(duration * {f}) THEN number END)::INT AS number FROM s GROUP BY image, duration"

QUERIES = {
    "frame_delay": (delayed, f"WITH {_DELAYED} SELECT * FROM d"),
    "frame_starts": (starts, f"WITH {_STARTS} SELECT *, start / duration AS progress FROM s"),
    "duration": (duration, f"WITH {_DELAYED} SELECT image, sum(delay)::BIGINT AS duration, count(*) AS frames FROM d GROUP BY image"),
    "seek": (_seek(0.5), f"WITH {_STARTS} {_SEEK.format(f='0.5::DOUBLE')}"),
    "seek_end": (_seek(7.0), f"WITH {_STARTS} {_SEEK.format(f='1')}"),
    "advance": (advance, _ADVANCE.format(starts=_STARTS)),
    "play_controls": (play_controls, None),
    "step_wrap": (step_wrap, f"WITH {_STARTS} SELECT image, number, CASE WHEN number = n - 1 THEN 0 ELSE number + 1 END::BIGINT AS after, CASE WHEN number = 0 THEN n - 1 ELSE number - 1 END AS before FROM s"),
    "frame_shrink": (
        frame_shrink,
        """WITH i AS (SELECT p_partkey AS image, p_size * 13 AS w, p_size * 7 + 1 AS h, p_partkey % 30 + 1 AS frames FROM part),
        f AS (SELECT image, w, h, frames, k FROM i, range(1, 700) t(k) WHERE k <= greatest(w, h) AND ceil(w / k) * ceil(h / k) * 4 * frames <= 200000)
        SELECT image, w, h, frames, coalesce((SELECT min(k) FROM f WHERE f.image = i.image), greatest(w, h))::INT AS factor FROM i""",
    ),
    "animation_bytes": (animation_bytes, "SELECT l_orderkey AS image, sum(l_linenumber * 10 * 20 * 4)::BIGINT AS bytes FROM lineitem GROUP BY 1"),
    "play_bar": (
        play_bar,
        "SELECT event_id, x BETWEEN 40 AND 440 AS hit, least(greatest((x - 40) / 400.0::DOUBLE, 0), 1) AS fraction FROM (SELECT event_id, floor(value)::BIGINT % 500 AS x FROM events)",
    ),
}
