"""Boxes, scales and plans as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fitted(w: Column, h: Column, box_w: int, box_h: int) -> tuple[Column, Column]:
    """Scaled into the box, never enlarged, at least 1 a side."""
    scale = F.least(F.lit(1.0), F.least(box_w / w, box_h / h))
    side = lambda n: F.greatest(F.floor(n * scale), F.lit(1)).cast("int")
    return side(w), side(h)


def filled(w: Column, h: Column, box_w: int, box_h: int) -> tuple[Column, Column]:
    """Scaled to the box, enlarged if need be."""
    scale = F.least(box_w / w, box_h / h)
    side = lambda n: F.greatest(F.floor(n * scale), F.lit(1)).cast("int")
    return side(w), side(h)


def capped(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Scaled down by the root of the excess of pixels."""
    pixels = w.cast("double") * h
    scale = F.when(pixels > most, F.sqrt(most / pixels)).otherwise(1.0)
    side = lambda n: F.greatest(F.floor(n * scale), F.lit(1)).cast("int")
    return side(w), side(h)


def shrink_factor(w: Column, h: Column, box_w: int, box_h: int) -> Column:
    """The smallest whole factor by which the sides, rounded up, are within the box."""
    return F.greatest(F.ceil(w / box_w), F.ceil(h / box_h), F.lit(1)).cast("int")


def pyramid_bytes(w: Column, h: Column) -> Column:
    """A base of 4-byte pixels and a third again."""
    return F.floor(w.cast("long") * h * 16 / 3).cast("long")


def memory_bytes(raw: Column, sourced: Column) -> Column:
    third = F.floor(raw / 3).cast("long")
    return F.when(sourced, third).otherwise(third + F.floor(raw / 2).cast("long"))


def jpeg_scale(w: Column, h: Column, box_w: Column, box_h: Column, orientation: Column, force: Column) -> Column:
    """Of 1/8, 2/8, 4/8 and 8/8 (in eighths) the smallest that covers the box, or if forced the largest within it, else the smallest.

    The box is as shown; a turned image meets it with its sides swapped.
    """
    turned = orientation >= 5
    bw, bh = F.when(turned, box_h).otherwise(box_w), F.when(turned, box_w).otherwise(box_h)
    covers = lambda n: (F.ceil(w * n / 8) >= bw) & (F.ceil(h * n / 8) >= bh)
    inside = lambda n: (F.ceil(w * n / 8) <= bw) & (F.ceil(h * n / 8) <= bh)
    cheap = F.when(covers(1), 1).when(covers(2), 2).when(covers(4), 4).otherwise(8)
    return F.when(force, F.when(inside(8), 8).when(inside(4), 4).when(inside(2), 2).otherwise(1)).otherwise(cheap)


def scaled_rows(rows: Column, eighths: Column) -> Column:
    return F.ceil(rows * eighths / 8).cast("int")


def gcd(a: Column, b: Column) -> Column:
    """Euclid over a fixed number of steps, enough for 32-bit numbers."""
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, lambda s: s["a"])


def restart_layout(w: Column, h: Column, interval: Column, wide: Column, tall: Column, parts: Column, subsampled: Column, most: int = 1024) -> Column:
    """Rows a step, intervals a step, intervals, steps and steps of margin of an image with restart markers; null if a step has over ``most`` rows.

    wide, tall: the largest sampling factors; an image of one part has single blocks whatever they are.
    """
    side = lambda factor: F.when(parts == 1, 8).otherwise(factor * 8)
    per_row, rows = F.ceil(w / side(wide)).cast("long"), F.ceil(h / side(tall)).cast("long")
    step = F.floor(interval / gcd(interval, per_row)).cast("long")
    found = F.struct(
        (step * side(tall)).alias("step_rows"),
        F.floor(step * per_row / interval).cast("long").alias("step_intervals"),
        F.ceil(per_row * rows / interval).cast("long").alias("intervals"),
        F.ceil(rows / step).cast("long").alias("steps"),
        F.when((parts == 3) & subsampled, 1).otherwise(0).alias("margin"),
    )
    return F.when((interval > 0) & (w > 0) & (h > 0) & (step * side(tall) <= most), found)


def fit_zoom(area_w: Column, area_h: Column, w: Column, h: Column) -> Column:
    return F.least(area_w / w, area_h / h)


def zoom_range(fit: Column) -> tuple[Column, Column]:
    return fit / 64, F.greatest(fit * 64, F.lit(32.0))


def zoom_at(x: Column, zoom: Column, anchor: Column, factor: Column, fit: Column) -> tuple[Column, Column]:
    """New zoom and offset; the image's point under the anchor stays there."""
    low, high = zoom_range(fit)
    new = F.least(F.greatest(zoom * factor, low), high)
    return new, anchor - (anchor - x) / zoom * new


def detail_wins(a: Column, b: Column, zoom: Column) -> Column:
    """Whether scale a is nearer to the zoom than b, as a ratio."""
    return F.abs(F.log(a / zoom)) < F.abs(F.log(b / zoom))


def cell_side(w: Column, h: Column, least: int = 256) -> Column:
    """The smallest power of two from ``least`` that holds both sides."""
    side = F.greatest(w, h)
    return F.element_at(F.filter(F.array(*[F.lit(least << k) for k in range(8)]), lambda s: s >= side), 1)


def max_pixels(ram: Column) -> Column:
    return F.greatest(F.floor(ram / 2 * 3 / 16), F.lit(128_000_000)).cast("long")


def cache_budget(room: Column) -> Column:
    return F.greatest(F.floor(room / 3), F.lit(512 << 20)).cast("long")


#: What a pixel of a drag and a press of a key zoom by.
DRAG_STEP, KEY_STEP = 0.005, math.sqrt(2)


def drag_zoom(pixels: Column) -> Column:
    return F.exp(DRAG_STEP * pixels)


def key_zoom(presses: Column) -> Column:
    return F.pow(F.lit(KEY_STEP), presses)


def oriented_rect(rect: dict[str, Column], mirror: bool, quarters: int) -> dict[str, Column]:
    """A rectangle of the unit square, mirrored first and then turned clockwise."""
    x0, y0, x1, y1 = rect["x"], rect["y"], rect["x"] + rect["w"], rect["y"] + rect["h"]
    if mirror:
        x0, x1 = 1 - x0, 1 - x1
    for _ in range(quarters):
        x0, y0, x1, y1 = 1 - y0, x0, 1 - y1, x1
    return {"x": F.least(x0, x1), "y": F.least(y0, y1), "w": F.abs(x1 - x0), "h": F.abs(y1 - y0)}


def refine_request(image: dict[str, Column], area: tuple[Column, Column], stored: tuple[Column, Column], zoom: Column, turn: tuple[bool, int], margin: float = 0.25) -> Column:
    """What of a scalable image is drawn again at the zoom shown: x, y, width, height in scaled pixels of the image as stored; null off screen.

    image: where it lies on screen; turn: mirror and quarter turns that undo its orientation; a share of the
    area's sides is added around what is seen, as far as the image goes.
    """
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    left, top = F.greatest(image["x"], F.lit(0.0)), F.greatest(image["y"], F.lit(0.0))
    right, bottom = F.least(image["x"] + image["w"], area[0]), F.least(image["y"] + image["h"], area[1])
    mx, my = area[0] * margin, area[1] * margin
    x0, x1 = (clamp((v - image["x"]) / image["w"]) for v in (left - mx, right + mx))
    y0, y1 = (clamp((v - image["y"]) / image["h"]) for v in (top - my, bottom + my))
    wide = oriented_rect({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}, *turn)
    sw, sh = stored[0] * zoom, stored[1] * zoom
    x, y = F.floor(wide["x"] * sw).cast("int"), F.floor(wide["y"] * sh).cast("int")
    w, h = F.ceil((wide["x"] + wide["w"]) * sw).cast("int") - x, F.ceil((wide["y"] + wide["h"]) * sh).cast("int") - y
    return F.when((right > left) & (bottom > top), F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))
