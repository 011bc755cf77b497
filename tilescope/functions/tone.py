"""Colour and tone as Column expressions, in double precision; curves are quantised at table slots."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the PQ and HLG curves, and of primaries (x, y of red, green, blue) under D65.
M1, M2 = 2610 / 16384, 2523 / 4096 * 128
C1, C2, C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
WHITE_NITS = 203.0
HLG_A = 0.17883277
HLG_B = 1 - 4 * HLG_A
HLG_C = 0.5 - HLG_A * math.log(4 * HLG_A)
D65 = (0.3127, 0.3290)
PRIMARIES = {
    "bt709": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060)),
    "p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)),
    "bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)),
}
SLOTS = 16383


def _num(c: Column | float) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


def pq_encoded(share: Column) -> Column:
    """Signal of light given as a share of 10000 nits."""
    p = F.power(share, F.lit(M1))
    return F.power((C1 + C2 * p) / (1 + C3 * p), F.lit(M2))


def pq_nits(signal: Column) -> Column:
    p = F.power(signal, F.lit(1 / M2))
    return 10000 * F.power(F.greatest(p - C1, F.lit(0.0)) / (C2 - C3 * p), F.lit(1 / M1))


def hlg_light(e: Column) -> Column:
    return F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - HLG_C) / HLG_A) + HLG_B) / 12)


def hlg_gain(luma: Column) -> Column:
    return F.when(luma > 0, (1000 / WHITE_NITS) * F.power(luma, F.lit(0.2))).otherwise(0.0)


def srgb_decode(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.power((v + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.power(v, F.lit(1 / 2.4)) - 0.055)


def slot(v: Column) -> Column:
    return F.floor(F.least(v, F.lit(1.0)) * SLOTS + 0.5)


def srgb_code(light: Column) -> Column:
    """8-bit code of light 0..1, through the table."""
    return F.floor(srgb_encode(slot(light) / SLOTS) * 255 + 0.5).cast("int")


def pq_code(light: Column, white: float = WHITE_NITS) -> Column:
    """10-bit code of light in units of white; the table is indexed by the root of light."""
    share = light * (WHITE_NITS / 10000) * (white / WHITE_NITS)
    at = F.floor(F.sqrt(F.least(share, F.lit(1.0))) * SLOTS + 0.5) / SLOTS
    return F.floor(pq_encoded(at * at) * 1023 + 0.5).cast("int")


def alpha_code(a: Column) -> Column:
    return F.floor(F.least(a, F.lit(1.0)) * 3 + 0.5).cast("int")


def finite(v: Column) -> Column:
    """Not a number and below 0 become 0; capped at a million."""
    return F.when(F.isnan(v) | (v <= 0), 0.0).otherwise(F.least(v, F.lit(1e6)))


def transfer_of_cicp(code: Column) -> Column:
    return F.when(code == 8, "linear").when(code == 16, "pq").when(code == 18, "hlg").otherwise("sdr")


def primaries_of_cicp(code: Column) -> Column:
    return F.when(code == 9, "bt2020").when(code.isin(11, 12), "p3").otherwise("bt709")


Matrix = list[list[float]]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(len(b[0]))] for i in range(3)]


def invert(m: Matrix) -> Matrix:
    cof = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum(m[0][j] * cof[0][j] for j in range(3))
    return [[cof[j][i] / det for j in range(3)] for i in range(3)]


def xyz_of(primaries: str) -> Matrix:
    """From linear RGB to XYZ: columns are the primaries, scaled so that they add up to white."""
    xyz = lambda x, y: [x / y, 1.0, (1 - x - y) / y]
    columns = [xyz(*p) for p in PRIMARIES[primaries]]
    base = [[columns[j][i] for j in range(3)] for i in range(3)]
    scale = multiply(invert(base), [[v] for v in xyz(*D65)])
    return [[base[i][j] * scale[j][0] for j in range(3)] for i in range(3)]


def conversion(source: str, target: str) -> Matrix:
    if source == target:
        return [[float(i == j) for j in range(3)] for i in range(3)]
    return multiply(invert(xyz_of(target)), xyz_of(source))


def apply_matrix(m: Matrix, r: Column, g: Column, b: Column) -> list[Column]:
    """A constant matrix times a colour: three dot products inside codegen."""
    return [row[0] * r + row[1] * g + row[2] * b for row in m]


def rolloff_scale(peak: Column, headroom: float = 1.0) -> Column:
    """By which all channels are scaled, from the largest of them."""
    knee = 0.8 * headroom
    room = headroom - knee
    over = F.greatest(peak - knee, F.lit(0.0))
    return F.when(peak > knee, (knee + room * over / (over + room)) / peak).otherwise(1.0)


def gain_weight(display: Column, base: Column, alternate: Column) -> Column:
    """How much of a gain map a display with this headroom (log2) gets; signed."""
    w = F.least(F.greatest((display - base) / (alternate - base), F.lit(0.0)), F.lit(1.0))
    return F.when(alternate == base, 0.0).when(alternate < base, 0.0 - w).otherwise(w)


def gain_factor(slot_1024: Column, low: float, high: float, gamma: float, weight: Column) -> Column:
    g = F.power(slot_1024 / 1023, F.lit(1 / gamma))
    return F.power(F.lit(2.0), (low + (high - low) * g) * weight)


def display_white(configured: Column, peak: Column) -> Column:
    return F.least(configured, peak / 1.25)


def display_headroom(peak: Column, white: Column) -> Column:
    return F.round(peak / white * 100) / 100


def widen(v8: Column) -> Column:
    return v8 * 257


def masked_channel(v: Column, bits: int) -> Column:
    """An n-bit channel in 8 bits; wider than 8 keeps the top 8."""
    if bits > 8:
        return F.shiftright(v, bits - 8).cast("int")
    low = (1 << bits) - 1
    return F.floor((v * 255 + low // 2) / low).cast("int")
