"""Request streams in batch form: latest wins, old generations are dropped, rests, what a file needs next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import last_at_or_before


def latest_wins(requests: DataFrame) -> DataFrame:
    """Of each session its last request."""
    order = F.struct("generation", "ts", "idx")
    best = requests.groupBy("session").agg(F.max(order).alias("b"))
    return best.select("session", "b.generation", "b.ts", "b.idx")


def current_only(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results for the current generation; those for older ones are dropped."""
    now = requests.groupBy("session").agg(F.max("generation").alias("generation"))
    return results.join(now, ["session", "generation"], "left_semi")


def gap_ms(ts: str, later: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.col(ts), later)


def debounce(requests: DataFrame, rest_ms: int) -> DataFrame:
    """Requests after which their session rested for ``rest_ms``, and each session's last."""
    order = Window.partitionBy("session").orderBy("ts", "generation")
    gap = gap_ms("ts", F.lead("ts").over(order))
    return requests.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= rest_ms)).drop("gap")


def flashing(switches: DataFrame, asked: DataFrame, ms: int = 1500) -> DataFrame:
    """asked: session, at.  Whether a switch of the session came at most ``ms`` before; questions before any switch are left out."""
    found = last_at_or_before(switches.withColumn("at", F.col("ts")), asked.select("session", "at", F.lit(0).alias("id")).distinct(), "session", "at", "ts")
    return found.where("found is not null").select("session", "at", (gap_ms("found", F.col("at")) < ms).alias("flashing"))


def delivered(entry: dict[str, Column]) -> Column:
    """What is posted of a cached entry: failed, full, building or preview."""
    return (
        F.when(entry["error"], "failed")
        .when(entry["streamed"], F.when(entry["tiles"], "full").otherwise("building"))
        .when(entry["whole"] | entry["scalable"], "full")
        .otherwise("preview")
    )


def wants_job(e: dict[str, Column]) -> Column:
    """What a file needs next: none, preview, whole, frames or later; the first rule that holds decides."""
    near = e["rank"] <= 1
    done = e["whole"] | e["scalable"]
    needs_frames = (e["rank"] == 0) & (e["n_frames"] > 1) & ~e["has_frames"]
    stream = (e["rank"] == 0) & ~e["has_tiles"] & ~e["error"] & (~e["hdr"] | e["display"])
    return (
        F.when(e["running"], "none")
        .when(~e["cached"], "preview")
        .when(e["streamed"], F.when(stream, "preview").otherwise("none"))
        .when(e["error"] | (done & ~needs_frames) | ~near, "none")
        .when(~e["rested"], "later")
        .when(e["whole"], "frames")
        .otherwise("whole")
    )


#: Order in which files are looked at for work.
def turn(rank: Column, ahead: int, behind: int) -> Column:
    """Current, nearest ahead, nearest behind, the rest ahead, the rest behind."""
    return (
        F.when(rank == 0, 0).when(rank == 1, 1).when(rank == ahead + 1, 2).when(rank <= ahead, rank + 1).when(rank <= ahead + behind, rank + 1).otherwise(F.lit(1 << 20))
    ).cast("int")


def pick(files: DataFrame) -> DataFrame:
    """files: session, idx, turn, job.  The first in turn that needs work."""
    best = files.where("job not in ('none', 'later')").groupBy("session").agg(F.min(F.struct("turn", "idx", "job")).alias("b"))
    return best.select("session", "b.idx", "b.job", "b.turn")


def streams(frames: Column, mode: Column, footprint: Column, pixels: Column, most: int) -> Column:
    """A still image is streamed from tiles in stream or footprint mode or beyond the most pixels."""
    return (frames <= 1) & (mode | footprint | (pixels > most))


def store_choice(footprint: Column, stream_all: Column, rebuild: Column, had_path: Column, persist: Column, huge: Column, small: Column) -> Column:
    disk = (~footprint | stream_all) & ((rebuild & had_path) | persist | huge)
    return F.struct(disk.alias("disk"), (small | (footprint & ~disk)).alias("small"))


def cancel(jobs: DataFrame) -> DataFrame:
    """jobs: session, idx, rank, kind.  Those out of the window, whole decodes no longer near, frames that are not current."""
    far = F.col("rank") >= (1 << 20)
    return jobs.where(far | ((F.col("kind") == "whole") & (F.col("rank") > 1)) | ((F.col("kind") == "frames") & (F.col("rank") > 0)))
