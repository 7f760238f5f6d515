"""Geometry, road attributes and array helpers as column expressions. Angles in degrees, lengths in metres.

Coordinates of an edge are an array of structs (lon, lat). Two constants are in use, as the data
model asks for: the great circle takes a radius of 6 371 000 m, plane distances 111 320 m a degree.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.config import OTHER_CAP, OTHER_TYPICAL, SPEED_CAPS, TYPICAL_SPEEDS

RADIUS_M = 6_371_000.0
M_PER_DEGREE = 111_320.0
TURN_DEGREES = 30.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(a))


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 north, clockwise."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360.0, F.lit(360.0))


def plane_m(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Plane distance with longitudes scaled at the first point's latitude."""
    return F.sqrt(F.pow((to_lat - lat) * M_PER_DEGREE, 2) + F.pow((to_lon - lon) * M_PER_DEGREE * F.cos(F.radians(lat)), 2))


def turn_deg(into: Column, out: Column) -> Column:
    """Signed turn in [-180, 180), positive to the right; a U-turn is -180."""
    return F.pmod(out - into + 540.0, F.lit(360.0)) - 180.0


def _by_class(road_class: Column, values: Mapping[str, float], other: float) -> Column:
    table = F.create_map(*(F.lit(x) for item in values.items() for x in item))
    return F.coalesce(F.try_element_at(table, F.regexp_replace(road_class, "_link$", "")), F.lit(other))


def speed_cap(road_class: Column) -> Column:
    return _by_class(road_class, SPEED_CAPS, OTHER_CAP)


def typical_speed(road_class: Column, overrides: Mapping[str, float] | None = None) -> Column:
    default = _by_class(road_class, TYPICAL_SPEEDS, OTHER_TYPICAL)
    if not overrides:
        return default
    table = F.create_map(*(F.lit(x) for k, v in overrides.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, road_class), default)


def parsed_maxspeed(tag: Column, road_class: Column) -> Column:
    """m/s of a maxspeed tag; bare numbers are km/h; the class's cap where it says nothing."""
    form = r"^\s*(\d+(?:\.\d+)?)\s*(km/h|kmh|kph|mph)?\s*$"
    value = F.expr("cast(null as double)") if tag is None else F.regexp_extract(tag, form, 1).try_cast("double")
    ms = F.when(F.regexp_extract(tag, form, 2) == "mph", value * 1609.344 / 3600).otherwise(value / 3.6)
    return F.when(ms > 0, ms).otherwise(speed_cap(road_class))


def directions(road_class: Column, oneway: Column) -> Column:
    """struct(forward, backward) of a way."""
    tag = F.lower(oneway)
    both = F.struct(F.lit(True).alias("forward"), F.lit(True).alias("backward"))
    forward = F.struct(F.lit(True).alias("forward"), F.lit(False).alias("backward"))
    backward = F.struct(F.lit(False).alias("forward"), F.lit(True).alias("backward"))
    untagged = F.when(road_class.isin("motorway", "motorway_link"), forward).otherwise(both)
    return F.when(oneway.isNull() | (tag == ""), untagged).when(tag.isin("-1", "reverse"), backward).when(tag.isin("yes", "true", "1"), forward).otherwise(both)


def _legs(coords: Column, f) -> Column:
    """f(a, b) of each pair of neighbours."""
    n = F.size(coords)
    return F.when(n > 1, F.zip_with(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))), F.slice(coords, 2, F.greatest(n - 1, F.lit(0))), f)).otherwise(F.array().cast("array<double>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def line_length_m(coords: Column) -> Column:
    return total(_legs(coords, lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"])))


def line_degrees(coords: Column) -> Column:
    """Length in degrees, the measure in which offsets are placed."""
    return total(_legs(coords, lambda a, b: F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2))))


def entry_bearing(coords: Column) -> Column:
    a, b = F.get(coords, F.lit(0)), F.get(coords, F.lit(1))
    return F.when(F.size(coords) > 1, azimuth_deg(a["lat"], a["lon"], b["lat"], b["lon"])).otherwise(0.0)


def exit_bearing(coords: Column) -> Column:
    a, b = F.try_element_at(coords, F.lit(-2)), F.try_element_at(coords, F.lit(-1))
    return F.when(F.size(coords) > 1, azimuth_deg(a["lat"], a["lon"], b["lat"], b["lon"])).otherwise(0.0)


def driven_entry(entry: Column, exit_: Column, backwards: Column) -> Column:
    return F.when(backwards, F.pmod(exit_ + 180.0, F.lit(360.0))).otherwise(entry)


def driven_exit(entry: Column, exit_: Column, backwards: Column) -> Column:
    return F.when(backwards, F.pmod(entry + 180.0, F.lit(360.0))).otherwise(exit_)


def true_runs(mask: Column) -> Column:
    """Maximal runs of true in an array of booleans."""
    starts = F.filter(F.transform(mask, lambda x, i: x & ~F.coalesce(F.get(mask, i - 1), F.lit(False))), lambda x: x)
    return F.coalesce(F.when(F.size(mask) > 0, F.size(starts)), F.lit(0))


def degree_position(offset_m: Column, length_m: Column, degrees: Column) -> Column:
    return F.when((length_m > 0) & (degrees > 0), offset_m / length_m * degrees).otherwise(0.0)


def point_at(coords: Column, length_m: Column, offset_m: Column) -> Column:
    """struct(lat, lon) at an offset, clamped to the edge; the first point of a degenerate edge."""
    clamped = F.least(F.greatest(offset_m, F.lit(0.0)), length_m)
    start = F.struct(degree_position(clamped, length_m, line_degrees(coords)).alias("left"), F.lit(False).alias("done"), F.get(coords, F.lit(0))["lat"].alias("lat"), F.get(coords, F.lit(0))["lon"].alias("lon"))
    legs = F.when(F.size(coords) > 1, F.sequence(F.lit(1), F.size(coords) - 1)).otherwise(F.array().cast("array<int>"))

    def step(x: Column, i: Column) -> Column:
        a, b = F.get(coords, i - 1), F.get(coords, i)
        size = F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2))
        share = F.when(size > 0, F.least(x["left"] / size, F.lit(1.0))).otherwise(0.0)
        here = F.struct((x["left"] - size).alias("left"), (x["left"] <= size).alias("done"), (a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"))
        return F.when(x["done"], x).otherwise(here)

    return F.aggregate(legs, start, step, lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))


def leg_share(size2: Column, dx: Column, dy: Column, a_lat: Column, a_lon: Column, lat: Column, lon: Column) -> Column:
    """Place of the nearest point of a leg, 0 at its start and 1 at its end."""
    return F.when(size2 > 0, F.least(F.greatest(((lon - a_lon) * dx + (lat - a_lat) * dy) / size2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def projected(coords: Column, length_m: Column, lat: Column, lon: Column) -> Column:
    """struct(perp_m, offset_m) of the point of an edge that is nearest in degrees (the first of equals)."""
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(float("inf")).alias("d2"), F.lit(0.0).alias("at"), F.lit(0.0).alias("plat"), F.lit(0.0).alias("plon"))
    legs = F.when(F.size(coords) > 1, F.sequence(F.lit(1), F.size(coords) - 1)).otherwise(F.array().cast("array<int>"))

    def step(x: Column, i: Column) -> Column:
        a, b = F.get(coords, i - 1), F.get(coords, i)
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        size2 = dx * dx + dy * dy
        t = leg_share(size2, dx, dy, a["lat"], a["lon"], lat, lon)
        px, py = a["lon"] + t * dx, a["lat"] + t * dy
        d2 = F.pow(lon - px, 2) + F.pow(lat - py, 2)
        near = d2 < x["d2"]
        pick = lambda new, old: F.when(near, new).otherwise(old)
        return F.struct((x["pos"] + F.sqrt(size2)).alias("pos"), pick(d2, x["d2"]).alias("d2"), pick(x["pos"] + t * F.sqrt(size2), x["at"]).alias("at"), pick(py, x["plat"]).alias("plat"), pick(px, x["plon"]).alias("plon"))

    def finish(x: Column) -> Column:
        known = x["pos"] > 0
        return F.struct(F.when(known, plane_m(lat, lon, x["plat"], x["plon"])).otherwise(F.lit(float("inf"))).alias("perp_m"), F.when(known, x["at"] / x["pos"] * length_m).otherwise(0.0).alias("offset_m"))

    return F.aggregate(legs, start, step, finish)


def log_student_t(d: Column, scale: float, df: float) -> Column:
    """Log density of a Student t distance; constants are folded on the driver."""
    import math

    if scale <= 0 or df <= 0:
        raise ValueError("scale and df must be positive")
    norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(scale)
    return F.when(d < float("inf"), F.lit(norm) - (df + 1) / 2 * F.log(1 + F.pow(d / scale, 2) / df)).otherwise(F.lit(float("-inf")))


def log_scale_gradient(d: Column, scale: float, df: float) -> Column:
    """Derivative of log_student_t by log scale; 0 where d is not finite."""
    return F.when(d < float("inf"), -1 + (df + 1) * d * d / (df * scale * scale + d * d)).otherwise(0.0)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - share of common elements of two sets; two empty sets are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / both)


def differing_share(a: Column, b: Column) -> Column:
    """Share of positions at which two arrays differ, over the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n <= 0, 0.0).otherwise(F.size(F.filter(F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: x != y), lambda x: x)) / n)
