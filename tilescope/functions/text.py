"""Text of titles, sizes and settings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without spaces and tabs around it."""
    return F.regexp_replace(c, "^[ \t]+|[ \t]+$", "")


def unquoted(c: Column) -> Column:
    return F.when(c.rlike('^".*"$') & (F.char_length(c) >= 2), F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)


def expanded(path: Column, home: str) -> Column:
    inside = path.startswith("~/") | path.startswith("~\\")
    return F.when(path == "~", F.lit(home)).when(inside, F.concat(F.lit(home + "/"), F.substring(path, F.lit(3), F.char_length(path)))).otherwise(path)


def abbreviated(path: Column, home: str) -> Column:
    inside = path.startswith(home + "/")
    return F.when(path == home, "~").when(inside, F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.char_length(path)))).otherwise(path)


def fixed(x: Column, places: int) -> Column:
    """A double of at least 0.5 with one or two decimals, as C's ``%.1f``: by its exact binary value, ties to even."""
    whole = F.floor(x)
    # the fraction is an exact multiple of 2^-53
    parts = ((x - whole) * float(1 << 53)).cast("long") * 10**places
    digits, rest = F.shiftright(parts, 53), parts.bitwiseAND(F.lit((1 << 53) - 1))
    up = (rest > 1 << 52) | ((rest == 1 << 52) & (digits % 2 == 1))
    digits = digits + up.cast("long")
    return F.format_string(f"%d.%0{places}d", whole + F.when(digits == 10**places, 1).otherwise(0), digits % 10**places)


def human_size(n: Column) -> Column:
    """Decimal units: B, kB without decimals, MB and GB with one; the unit changes where rounding would show 1000."""
    kilo = F.format_string("%d kB", F.bround(n / 1000.0, 0).cast("long"))
    tenth = lambda unit, name: F.concat(fixed(n / float(unit), 1), F.lit(name))
    return F.when(n < 1000, F.format_string("%d B", n)).when(n < 999_500, kilo).when(n < 999_950_000, tenth(10**6, " MB")).otherwise(tenth(10**9, " GB"))


def fitted_text(c: Column, width: Column, glyph: Column) -> Column:
    """As many code points as fit; cut ones end in three dots if there is room for more than those."""
    room = F.greatest(F.floor(width / glyph), F.lit(0)).cast("int")
    return F.when(F.char_length(c) <= room, c).when(room <= 3, F.left(c, room)).otherwise(F.concat(F.left(c, room - 3), F.lit("...")))


def failure_text(message: Column, path: Column) -> Column:
    head = F.concat(path, F.lit(": "))
    return F.when(F.startswith(message, head), F.substring(message, F.char_length(head) + 1, F.char_length(message))).otherwise(message)


def details(name: Column, w: Column, h: Column, kind: Column, size: Column) -> Column:
    return F.concat_ws("  ", name, F.format_string("%d x %d", w, h), kind, human_size(size))


def property_of(xmp: Column, name: str) -> Column:
    """An XMP property, as attribute or else as element."""
    attribute = F.regexp_extract(xmp, rf'hdrgm:{name}="([^"]*)"', 1)
    element = F.regexp_extract(xmp, rf"<hdrgm:{name}>([^<]*)</hdrgm:{name}>", 1)
    return F.when(attribute != "", attribute).when(element != "", element)


def numbers_of(xmp: Column, name: str) -> Column:
    """One or three numbers of a property, always three; null if it is absent or not numeric."""
    inside = F.regexp_extract(xmp, rf"<hdrgm:{name}>(.*?)</hdrgm:{name}>", 1)
    items = F.regexp_extract_all(inside, F.lit("<rdf:li>([^<]*)</rdf:li>"), F.lit(1))
    some = F.when(F.size(items) > 0, items).otherwise(F.array(property_of(xmp, name)))
    found = F.transform(some, lambda s: F.trim(s).try_cast("double"))
    return F.when(F.size(found) == 1, F.array_repeat(found[0], 3)).when(F.size(found) == 3, found)


def view_box(svg: Column) -> Column:
    """Four numbers of a viewBox; null unless there are four and the sides are positive."""
    raw = F.regexp_extract(svg, r"viewBox\s*=\s*[\"']([^\"']*)[\"']", 1)
    parts = F.transform(F.split(F.trim(F.regexp_replace(raw, "[\\s,]+", " ")), " "), lambda s: s.try_cast("double"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull()) & (parts[2] > 0) & (parts[3] > 0), parts)


def svg_axis(whole: Column, box: Column, origin: Column, scale: Column, align: int) -> Column:
    """Offset of one axis; align 0, 1, 2 for min, mid, max."""
    return (whole - box * scale) * align / 2 - origin * scale


def setting_in_range(text: Column, low: int, high: int) -> Column:
    """A whole number with nothing around it, within bounds; null otherwise."""
    v = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("int"))
    return F.when(v.between(low, high), v)


def hex_digits(n: Column) -> Column:
    """An unsigned number of up to 64 bits, as a decimal, in sixteen hexadecimal digits."""
    return F.lpad(F.lower(F.conv(n.cast("string"), 10, 16)), 16, "0")


def cache_identity(size: Column, contents: Column, headroom: Column, white: Column) -> Column:
    """What a cache is named by: size and contents, on an HDR display its headroom, and its white where that is not 203 nits."""
    tag = F.when(headroom > 1, F.concat(F.lit("|pq|"), fixed(headroom, 2), F.when(white != 203, F.format_string("|%.0f", white)).otherwise("")))
    return F.concat(size.cast("string"), F.lit("|"), hex_digits(contents), F.coalesce(tag, F.lit("")))
