"""Column expressions: cleaning, time, codes, geography.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def clean(c: Column) -> Column:
    """Without white space at the ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def category_levels(c: Column, paths: str = "|", levels: str = ";") -> Column:
    """Levels of the first path that is not blank."""
    path = F.get(F.filter(F.split(c, f"[{paths}]"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.transform(F.split(path, levels), F.trim)


def full_path(levels: Column, depth: int = 3) -> Column:
    """Exactly ``depth`` levels, none of them blank."""
    return F.coalesce((F.size(levels) == depth) & F.forall(levels, lambda x: x != ""), F.lit(False))


def has_zone(c: Column) -> Column:
    return c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def utc_time(c: Column, offset_minutes: int = 480) -> Column:
    """UTC wall time of a text: its own zone, or a fixed offset where it has none; null if it is no time."""
    zone = F.regexp_extract(c, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    local = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    own = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    minutes = F.when(zone == "", F.lit(offset_minutes)).when(zone == "Z", F.lit(0)).otherwise(own)
    return local - F.make_dt_interval(mins=minutes)


def weekday_time(c: Column) -> Column:
    """UTC wall time of a text such as ``Tue Apr 03 18:00:09 +0000 2012``; null if it is no time."""
    rest = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}\s+", "")
    return F.try_to_timestamp(rest, F.lit("MMM dd HH:mm:ss Z yyyy"))


def category_key(c: Column) -> Column:
    """A category's name for look-ups: lower case, plain e in cafe, blanks for hyphens, single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(c), F.lit("café"), F.lit("cafe")), F.lit("-"), F.lit(" ")), r"\s+", " "))


def prompt_parts(c: Column) -> list[Column]:
    """The time and the user that a prompt asks about; empty where it asks about none."""
    pattern = r"(?i)When (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) user_(\S+) is likely to visit:"
    return [F.regexp_extract(c, pattern, i) for i in (1, 2)]


def sid_tokens(levels: Column) -> Column:
    """[3, 1] as <a_3><b_1>; more levels than letters are an error."""
    text = F.array_join(F.transform(levels, lambda v, i: F.concat(F.lit("<"), F.char(i + 97), F.lit("_"), v.cast("string"), F.lit(">"))), "")
    return F.when(F.size(levels) > 26, F.raise_error(F.lit("a code has at most 26 levels")).cast("string")).otherwise(text)


def sid_canonical(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"<[a-z]_\d+>"), F.lit(0)), "")


def sid_levels(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"<[a-z]_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Geohash text: a cell's number along each axis, their bits dealt in turn, five to a letter; a point off the map is an error."""
    bits = 5 * precision
    wide, high = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << wide)), F.lit((1 << wide) - 1))
    y = F.least(F.floor((lat + 90) / 180 * (1 << high)), F.lit((1 << high) - 1))
    x, y = F.lpad(F.bin(x.cast("long")), wide, "0"), F.lpad(F.bin(y.cast("long")), high, "0")
    dealt = F.concat(*[F.substring(x if i % 2 == 0 else y, i // 2 + 1, 1) for i in range(bits)])
    letters = [F.substring(F.lit(GEOHASH), F.conv(F.substring(dealt, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(precision)]
    off = ~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    return F.when(off, F.raise_error(F.lit("a coordinate is out of range")).cast("string")).otherwise(F.concat(*letters))


def spherical(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test over the edges of a ring array<array<double>>; a point on an edge is inside."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))
    edge = lambda e: (F.abs((e.bx - e.ax) * (y - e.ay) - (e.by - e.ay) * (x - e.ax)) <= 1e-10) & x.between(F.least(e.ax, e.bx) - 1e-10, F.greatest(e.ax, e.bx) + 1e-10) & y.between(F.least(e.ay, e.by) - 1e-10, F.greatest(e.ay, e.by) + 1e-10)
    cross = lambda e: ((e.ay > y) != (e.by > y)) & (x < (e.bx - e.ax) * (y - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax)
    return F.exists(edges, edge) | (F.size(F.filter(edges, lambda e: F.coalesce(cross(e), F.lit(False)))) % 2 == 1)


def in_polygons(x: Column, y: Column, polygons: Column) -> Column:
    """In the outer ring of one of several polygons and in none of its holes."""
    return F.exists(polygons, lambda p: in_ring(x, y, p[0]) & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda h: in_ring(x, y, h)))


def dcg(rank: Column) -> Column:
    return F.when(rank.between(1, 10), 1 / F.log2(rank + 1)).otherwise(0.0)


def relative(now: Column, base: Column) -> Column:
    """Percent change, null on a zero base."""
    return F.when(base != 0, (now - base) / base * 100)
