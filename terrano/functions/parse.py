"""Parsers of textual registry and road values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: km/h of zone tags.
ZONES = {"pl:motorway": 140, "pl:trunk": 120, "pl:expressway": 120, "pl:rural": 90, "pl:urban": 50, "pl:zone30": 30, "pl:zone:30": 30, "pl:bicycle_road": 30, "pl:living_street": 20}
#: Fixed values: (class, rural km/h, urban km/h, lane capacity in vehicles an hour).
ROADS = [
    ("motorway", 140, 140, 2000), ("motorway_link", 80, 60, 1500), ("trunk", 120, 110, 1800), ("trunk_link", 60, 40, 1400),
    ("primary", 90, 60, 1400), ("primary_link", 70, 60, 1000), ("secondary", 90, 50, 1200), ("secondary_link", 60, 50, 900),
    ("tertiary", 90, 50, 900), ("tertiary_link", 60, 50, 700), ("unclassified", 70, 50, 600), ("road", 70, 50, 600),
    ("residential", 50, 40, 600), ("living_street", 20, 20, 300), ("service", 30, 30, 300), ("unpaved", 40, 30, 600),
]
UNKNOWN_SPEED = 40


def to_number(c: Column) -> Column:
    """Spaces dropped, decimal comma read; anything else that is no number is null."""
    return F.regexp_replace(F.regexp_replace(c, "\\s", ""), ",", ".").try_cast("double")


def reported(c: Column) -> Column:
    """A published cell: empty and zero mean suppressed."""
    x = to_number(c)
    return F.when(x == 0, F.lit(None).cast("double")).otherwise(x)


def year_of(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def market_category(c: Column) -> Column:
    return F.when(c == "pierwotny", "primary").when(c == "wtorny", "secondary").otherwise("unknown")


def max_speed(c: Column) -> Column:
    """km/h of a speed tag: the least of its parts within 3..150; null if it states none."""
    low = F.lower(F.trim(c))
    zone = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])

    def part(p: Column) -> Column:
        p = F.trim(p)
        n = F.regexp_extract(p, "([0-9]{1,3}(?:\\.[0-9]+)?)", 1).try_cast("double")
        run = F.regexp_extract(p, "([0-9]{2,3})", 1).try_cast("double")
        v = F.when(F.try_element_at(zone, p).isNotNull(), F.try_element_at(zone, p).cast("double")).when(p == "walk", 5.0)
        return v.when(p.contains("mph"), n * 1.609344).when(p.contains("km/h") | p.contains("kph"), n).otherwise(run)

    parts = F.transform(F.split(low, "[;,]"), part)
    return F.array_min(F.filter(parts, lambda x: x.isNotNull() & (x >= 3) & (x <= 150)))


def builtup(zone: Column) -> Column:
    """False for a rural zone tag, true for an urban one or a zone, else null; rural is looked for first."""
    z = F.lower(zone)
    return F.when(z.rlike("rural"), False).when(z.rlike("urban|zone"), True)


def directions(oneway: Column, junction: Column, road: Column) -> tuple[Column, Column]:
    """(forward, backward): an explicit no opens both ways."""
    o = F.lower(F.coalesce(oneway, F.lit("")))
    back = o.isin("-1", "reverse")
    no = o.isin("no", "false", "0")
    only = o.isin("yes", "true", "1") | F.coalesce(junction == "roundabout", F.lit(False)) | F.coalesce(road == "motorway", F.lit(False))
    return no | ~back, no | back | ~only


def class_speed(road: Column, urban: Column, factor: float = 1.0, profile: dict[str, tuple[float, float]] | None = None) -> Column:
    """km/h of a class, outside and inside built-up areas as the profile has them; classes it lacks get one speed."""
    known = profile or {c: (r, u) for c, r, u, _ in ROADS}
    rural_, urban_ = (F.create_map(*[F.lit(x) for c, v in known.items() for x in (c, float(v[k]))]) for k in (0, 1))
    v = F.when(urban, F.try_element_at(urban_, road)).otherwise(F.try_element_at(rural_, road))
    return F.coalesce(v, F.lit(float(UNKNOWN_SPEED))) * factor


def lane_capacity(road: Column, lanes: Column, oneway: Column) -> Column:
    """Vehicles an hour: the first number of lanes stated, at least one; else one lane where nothing comes back, two elsewhere."""
    per = F.create_map(*[F.lit(x) for c, _, _, k in ROADS for x in (c, float(k))])
    stated = F.nullif(F.get(F.split(lanes, ";"), F.lit(0)).try_cast("double"), F.lit(float("nan")))
    n = F.coalesce(F.when(stated.isNotNull(), F.greatest(F.floor(stated).cast("double"), F.lit(1.0))), F.when(oneway, 1.0).otherwise(2.0))
    return F.coalesce(F.try_element_at(per, road), F.lit(600.0)) * n


def edge_seconds(metres: Column, kmh: Column) -> Column:
    return metres / (F.greatest(kmh, F.lit(1.0)) / 3.6)


def repaired(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read right."""
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


def shown(c: Column, places: int = 3) -> Column:
    return F.coalesce(F.format_number(F.nullif(c, F.lit(float("nan"))), places), F.lit("--"))


#: Class of a navigation map -> class whose speed holds on national roads.
MAP_CLASSES = {
    "motorway": "motorway", "trunk": "primary", "primary": "secondary", "secondary": "tertiary", "tertiary": "unclassified",
    "residential": "residential", "unpaved": "unpaved", "alley": "service", "private": "service", "service": "service",
}
#: Labels of numbered roads, the class they make and the speed they allow at least.
NUMBERED = [(r"^A\d{1,2}$", "motorway", 140.0), (r"^S\d{1,3}$", "trunk", 120.0)]


def map_class(cls: Column, label: Column, numbered: bool = True) -> Column:
    """Road class of a navigation map's line; classes that cannot be driven are null."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in MAP_CLASSES.items() for x in kv]), cls)
    for pattern, road, _ in reversed(NUMBERED if numbered else []):
        known = F.when(F.trim(label).rlike(pattern), road).otherwise(known)
    return known


def numbered_speed(kmh: Column, label: Column) -> Column:
    """A speed, raised to what a numbered road allows."""
    out = kmh.cast("double")
    for pattern, _, least in reversed(NUMBERED):
        out = F.when(F.trim(label).rlike(pattern), F.greatest(F.coalesce(kmh.cast("double"), F.lit(0.0)), F.lit(least))).otherwise(out)
    return out


def reply_count(raw: Column, name: str) -> Column:
    """The integer attribute (numberMatched, numberReturned) of a feature reply; null where it is none."""
    return F.regexp_extract(raw, name + r'="(\d+)"', 1).try_cast("long")


def labelled(c: Column, width: int) -> Column:
    """A label cut to width characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("\u2026"))).otherwise(c)
