"""Sequences whose next state depends on the one before: playback, views, caches under change.

A session's events are read in order by one task that holds its last state and nothing
else; sessions spread over tasks, and a session of any length streams through.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(events: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], Any], step: Callable[..., tuple], schema: str) -> DataFrame:
    """A row for each event: key, order and what ``step(state, *columns)`` gives.

    ``start`` makes a session's first state, which ``step`` changes.
    """
    names = [key, *order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for rows in batches:
            out = []
            for who, *values in rows[[key, *columns]].itertuples(index=False, name=None):
                if state is None or who != last:
                    last, state = who, start()
                out.append(step(state, *values))
            yield pd.concat([rows[names].reset_index(drop=True), pd.DataFrame(out, columns=given)], axis=1)

    given = [f.split()[0] for f in schema.split(", ")]
    head = ", ".join(f"{n} {events.schema[n].dataType.simpleString()}" for n in names)
    chosen = events.select(*dict.fromkeys([*names, *columns]))
    return chosen.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{head}, {schema}")


class Player:
    """An animation as it plays: the frame, and when it is due to change."""

    def __init__(self) -> None:
        self.frame, self.due, self.playing, self.opened = 0, 0, True, False

    def open(self, delays: list[int], at: int) -> None:
        if not self.opened:
            self.opened, self.due = True, at + delays[0]

    def catch_up(self, delays: list[int], now: int) -> None:
        """Past all frames that are due; after a stall of a whole run or more, one frame from now on."""
        if not self.playing or now < self.due:
            return
        run = sum(delays)
        if now - self.due >= run:
            self.due = now
        while now >= self.due:
            self.frame = (self.frame + 1) % len(delays)
            self.due += delays[self.frame]

    def toggle(self, delays: list[int], now: int) -> None:
        self.playing = not self.playing
        self.due = now + delays[self.frame]

    def step(self, delays: list[int], by: int) -> None:
        self.playing = False
        self.frame = (self.frame + by) % len(delays)

    def seek(self, delays: list[int], share: float, now: int) -> None:
        ends, total = [], 0
        for d in delays:
            total += d
            ends.append(total)
        target = int(min(max(share, 0.0), 1.0) * total)
        self.frame = min(bisect.bisect_right(ends, target), len(delays) - 1)
        self.due = now + delays[self.frame]


def _with_delays(starts: DataFrame, asked: DataFrame) -> DataFrame:
    """Each event with its image's delays, in order of frames."""
    delays = starts.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", F.col("delay").cast("int").alias("delay")))), lambda s: s["delay"]).alias("delays"))
    return asked.join(delays, "image")


def advance(starts: DataFrame, elapsed: DataFrame) -> DataFrame:
    """elapsed: image, at (ms since the image was opened), one for each look at the clock.

    image, at, number, left: the frame that shows then and the time until the next one; what it is depends
    on the looks before, since after a stall of a whole run playing goes on from where it stood.
    """

    def step(player: Player, at: int, delays: list[int]) -> tuple:
        found = [int(d) for d in delays]
        player.open(found, 0)
        player.catch_up(found, int(at))
        return player.frame, player.due - int(at)

    return fold(_with_delays(starts, elapsed), "image", ["at"], ["at", "delays"], Player, step, "number int, left bigint")


def play(starts: DataFrame, events: DataFrame) -> DataFrame:
    """events: image, seq, at, what (tick, toggle, step, back or seek), share.  image, seq, number, playing."""

    def step(player: Player, at: int, what: str, share: float, delays: list[int]) -> tuple:
        found = [int(d) for d in delays]
        player.open(found, 0)
        if what == "tick":
            player.catch_up(found, int(at))
        elif what == "toggle":
            player.toggle(found, int(at))
        elif what == "seek":
            player.seek(found, float(share), int(at))
        else:
            player.step(found, 1 if what == "step" else -1)
        return player.frame, player.playing

    return fold(_with_delays(starts, events), "image", ["seq"], ["at", "what", "share", "delays"], Player, step, "number int, playing boolean")


class View:
    """Where an image lies in its area: x, y and zoom."""

    def __init__(self) -> None:
        self.x = self.y = 0.0
        self.zoom = self.fit = 0.0


def view_states(events: DataFrame, width: int, height: int) -> DataFrame:
    """events: session, seq, what (fit, centre, pan, zoom), w, h (of the image), a, b, factor.  x, y, zoom after each.

    ``a``, ``b``: what a pan moves by, or where a zoom holds the image; a zoom stays within a range about the fit.
    """

    def step(v: View, what: str, w: int, h: int, a: float, b: float, factor: float) -> tuple:
        if what == "fit" or not v.fit:
            v.fit = v.zoom = min(width / w, height / h)
        if what in ("fit", "centre"):
            v.x, v.y = (width - w * v.zoom) / 2, (height - h * v.zoom) / 2
        elif what == "pan":
            v.x, v.y = v.x + a, v.y + b
        else:
            old, v.zoom = v.zoom, min(max(v.zoom * factor, v.fit / 64), max(v.fit * 64, 32.0))
            v.x, v.y = a - (a - v.x) / old * v.zoom, b - (b - v.y) / old * v.zoom
        return round(v.x, 6), round(v.y, 6), round(v.zoom, 9)

    return fold(events, "session", ["seq"], ["what", "w", "h", "a", "b", "factor"], View, step, "x double, y double, zoom double")


class Held:
    """A cache's entries by name: bytes, whether streamed, sides and orientation."""

    def __init__(self) -> None:
        self.entries: dict[int, list] = {}
        self.bytes, self.streaming = 0, False

    def drop(self, file: int) -> bool:
        gone = self.entries.pop(file, None)
        self.bytes -= gone[0] if gone else 0
        return gone is not None


def cache_changes(events: DataFrame, most: int) -> DataFrame:
    """events: session, seq, what, file, bytes, streamed, w, h, orientation.  What a cache holds after each.

    put adds or replaces an entry; forget and rebuild drop it; reoriented turns it, its sides swapped if the
    turn needs it; stream_all switches modes, where it differs, and drops all but streamed images beyond ``most`` pixels.
    """

    def step(held: Held, what: str, file: int, size: int, streamed: bool, w: int, h: int, orientation: int) -> tuple:
        if what == "put":
            held.drop(file)
            held.entries[file] = [int(size), bool(streamed), int(w), int(h), int(orientation)]
            held.bytes += int(size)
        elif what in ("forget", "rebuild"):
            held.drop(file)
        elif what == "reoriented" and file in held.entries:
            e = held.entries[file]
            if (e[4] >= 5) != (orientation >= 5):
                e[2], e[3] = e[3], e[2]
            e[4] = int(orientation)
        elif what == "stream_all" and held.streaming != bool(streamed):
            held.streaming = bool(streamed)
            for gone in [f for f, e in held.entries.items() if not (e[1] and e[2] * e[3] > most)]:
                held.drop(gone)
        e = held.entries.get(file)
        return len(held.entries), held.bytes, e[2] if e else None, e[4] if e else None

    schema = "files bigint, held bigint, width int, turned int"
    out = fold(events, "session", ["seq"], ["what", "file", "bytes", "streamed", "w", "h", "orientation"], Held, step, "files bigint, held bigint, width double, turned double")
    return out.select("session", "seq", *[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")])


class Lru:
    """Keys in order of their last use, pinned ones apart."""

    def __init__(self) -> None:
        self.free: dict[int, int] = {}
        self.pinned: dict[int, int] = {}
        self.total = 0


def lru_log(log: DataFrame, budget: int) -> DataFrame:
    """log: cache, seq, key, bytes, pinned.  Replays accesses against a budget: ``hit``, ``evicted`` (how many) and ``held`` bytes after each.

    Pinned tiles are never evicted, nor is the one just put; putting a key again replaces it.  A step
    takes the oldest off as often as it must, so a replay costs what it evicts.
    """

    def step(lru: Lru, key: int, size: int, pin: bool) -> tuple:
        old = lru.free.pop(key, None)
        old = lru.pinned.pop(key, None) if old is None else old
        lru.total += int(size) - (old or 0)
        (lru.pinned if pin else lru.free)[key] = int(size)
        gone = 0
        while lru.total > budget and (oldest := next(iter(lru.free), key)) != key:
            lru.total -= lru.free.pop(oldest)
            gone += 1
        return old is not None, gone, lru.total

    return fold(log, "cache", ["seq"], ["key", "bytes", "pinned"], Lru, step, "hit boolean, evicted bigint, held bigint")


def wait_ms(now: Column, loading: Column, tick: int, deadlines: list[tuple[Column, Column]]) -> Column:
    """Milliseconds until the first deadline that counts, 0 if it is past; -1 without any.  deadlines: (counts, at)."""
    left = [F.when(loading, F.lit(tick).cast("long")), *[F.when(counts, F.greatest(at - now, F.lit(0).cast("long"))) for counts, at in deadlines]]
    return F.coalesce(F.array_min(F.array(*left)), F.lit(-1).cast("long"))
