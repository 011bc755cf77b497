"""Settings files: lines of ``key = value``, comments, quotes; the last valid value of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The keys of a settings file, what each may hold, and what holds where a file doesn't say.
KEYS = {
    "cache": (None, ""),
    "cache_mode": (("fast", "small"), "fast"),
    "streaming_mode": (("on", "off"), "off"),
    "persist_streams": (("on", "off"), "off"),
    "memory_mode": (("speed", "footprint"), "speed"),
    "sort": (("a-z", "z-a", "newest", "oldest", "size"), "a-z"),
    "prevent_sleep": (("always", "fullscreen", "never"), "fullscreen"),
    "hdr_white": ((50, 1000), "100"),
}
DEFAULTS = {key: default for key, (_, default) in KEYS.items()}


def lines(files: DataFrame) -> DataFrame:
    """files: file, content.  file, line_no, line, key, value; comments and blank lines are left out; without ``=`` no key."""
    split = files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    said = split.withColumn("line", T.trimmed(F.regexp_replace("line", "\r$", ""))).where("line <> '' and not startswith(line, '#')")
    has = F.contains("line", F.lit("="))
    key, value = F.split_part("line", F.lit("="), F.lit(1)), F.regexp_extract("line", "(?s)^[^=]*=(.*)$", 1)
    return said.select("file", (F.col("at") + 1).alias("line_no"), "line", F.when(has, T.trimmed(key)).alias("key"), F.when(has, T.unquoted(T.trimmed(value))).alias("value"))


def checked(parsed: DataFrame) -> DataFrame:
    """Adds ``problem``: what a warning says of the line, or null."""
    key, value = F.col("key"), F.col("value")
    good = F.when(F.lit(False), F.lit(True))
    for name, (may, _) in KEYS.items():
        holds = F.lit(True) if may is None else T.setting_in_range(value, *may).isNotNull() if isinstance(may[0], int) else value.isin(*may)
        good = good.when(key == name, holds)
    problem = (
        F.when(key.isNull(), F.concat(F.lit('expected key = value, found "'), F.col("line"), F.lit('"')))
        .when(~key.isin(*KEYS), F.concat(F.lit('unknown key "'), key, F.lit('"')))
        .when(~good, F.concat(key, F.lit(' cannot be "'), value, F.lit('"')))
    )
    return parsed.withColumn("problem", problem)


def settings(files: DataFrame) -> DataFrame:
    """file, key, value: the last valid value of each key, or else its default."""
    valid = checked(lines(files)).where("problem is null").groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("default")) for k, v in DEFAULTS.items()]))
    every = files.select("file", pairs.alias("p")).select("file", "p.*")
    return every.join(valid, ["file", "key"], "left").select("file", "key", F.coalesce("value", "default").alias("value"))


def warnings(files: DataFrame) -> DataFrame:
    return checked(lines(files)).where("problem is not null").select("file", "line_no", F.col("problem").alias("warning"))


def missing(files: DataFrame) -> DataFrame:
    """file, key, value of settings that a file does not mention, with their defaults: an anti-join.  A bad value is a mention."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in DEFAULTS.items()]))
    return files.select("file", pairs.alias("p")).select("file", "p.*").join(lines(files).where("key is not null").select("file", "key").distinct(), ["file", "key"], "left_anti")


def completed(files: DataFrame) -> DataFrame:
    """file, content: with a line behind it for each setting that is missing, in the order of ``KEYS``."""
    turn = F.array_position(F.array(*map(F.lit, KEYS)), F.col("key"))
    added = missing(files).select("file", turn.alias("turn"), F.rtrim(F.concat(F.col("key"), F.lit(" = "), F.col("value"))).alias("line"))
    added = added.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("some"))  # at most a line a key
    more = F.concat(F.array_join(F.transform("some", lambda s: s["line"]), "\n"), F.lit("\n"))
    gap = F.when((F.col("content") != "") & ~F.endswith("content", F.lit("\n")), "\n").otherwise("")
    return files.join(added, "file", "left").select("file", F.when(F.col("some").isNull(), F.col("content")).otherwise(F.concat("content", gap, more)).alias("content"))
