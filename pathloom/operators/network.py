"""The road network as tables, and its relational operators.

An edge row has link_id, road_class, from_node, to_node, coords, length_m, max_ms, typ_ms,
signal, stop, deg_from, deg_to (total degrees), entry_deg, exit_deg, lo, hi (undirected key),
twin (link of the reverse edge or null) and its bounding box. Joins on link_id or on grid cell
replace in-memory lookups and trees, so a network of any size is dealt over the cluster; Spark
broadcasts it where its measured size allows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.config import Config
from pathloom.functions import geo
from pathloom.sources.work import kept

#: Side of a grid cell in degrees.
CELL = 0.004
#: Parts of that side that are tried, finest first: fewer edges lie in a small cell, but more rows in all.
PARTS = (8, 4, 2, 1)
#: Edges by cell that are broadcast; above that points meet them by a shuffle.
BROADCAST_CELLS = 200_000
DEFAULT = Config()


def node_degrees(records: DataFrame) -> DataFrame:
    """node_id, degree: edges in and out."""
    ends = records.select(F.explode(F.array("from_node", "to_node")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def adjacency(records: DataFrame) -> DataFrame:
    """node_id and the links that leave it."""
    return records.groupBy(F.col("from_node").alias("node_id")).agg(F.array_sort(F.collect_list("link_id")).alias("links"))


def node_positions(records: DataFrame) -> DataFrame:
    """node_id, lat, lon from the ends of edges; the largest link has the last word."""
    first, last = F.get("coords", F.lit(0)), F.element_at("coords", -1)
    ends = records.select("link_id", F.explode(F.array(F.struct(F.col("from_node").alias("node_id"), F.lit(0).alias("end"), first.alias("p")), F.struct(F.col("to_node").alias("node_id"), F.lit(1).alias("end"), last.alias("p")))).alias("x"))
    return ends.groupBy("x.node_id").agg(F.max_by("x.p", F.struct("link_id", "x.end")).alias("p")).select("node_id", "p.lat", "p.lon")


def twins(records: DataFrame) -> DataFrame:
    """link_id, twin: the edge with swapped ends whose length is within 1 m or 0.1 %, the closest (then smallest); null if none."""
    back = records.select(F.col("link_id").alias("twin"), F.col("from_node").alias("to_node"), F.col("to_node").alias("from_node"), F.col("length_m").alias("__len"))
    gap = F.abs(F.col("length_m") - F.col("__len"))
    found = records.select("link_id", "from_node", "to_node", "length_m").where("from_node <> to_node").join(back, ["from_node", "to_node"]).where(gap <= F.greatest(F.lit(1.0), 0.001 * F.col("length_m")))
    best = found.groupBy("link_id").agg(F.min_by("twin", F.struct(gap, "twin")).alias("twin"))
    return records.select("link_id").join(best, "link_id", "left")


def build(records: DataFrame, controls: DataFrame | None = None, typical: Mapping[str, float] | None = None) -> DataFrame:
    """Edge rows from records (link_id, road_class, max_speed_ms, coords, from_node, to_node, length_m) and control nodes (kind, node_id)."""
    degrees = node_degrees(records)
    rows = records.join(degrees.select(F.col("node_id").alias("to_node"), F.col("degree").alias("deg_to")), "to_node").join(degrees.select(F.col("node_id").alias("from_node"), F.col("degree").alias("deg_from")), "from_node")
    for kind in ("signal", "stop"):
        if controls is None:
            rows = rows.withColumn(kind, F.lit(False))
        else:
            flags = controls.where(F.col("kind") == kind).select(F.col("node_id").alias("to_node"), F.lit(True).alias(kind)).distinct()
            rows = rows.join(flags, "to_node", "left").withColumn(kind, F.coalesce(kind, F.lit(False)))
    rows = rows.join(twins(records), "link_id")
    c = F.col("coords")
    xs, ys = F.transform(c, lambda p: p["lon"]), F.transform(c, lambda p: p["lat"])
    return rows.select(
        "link_id", "road_class", "from_node", "to_node", "coords", "length_m", F.col("max_speed_ms").alias("max_ms"), geo.typical_speed(F.col("road_class"), typical).alias("typ_ms"),
        "signal", "stop", "deg_from", "deg_to", geo.entry_bearing(c).alias("entry_deg"), geo.exit_bearing(c).alias("exit_deg"),
        F.least("from_node", "to_node").alias("lo"), F.greatest("from_node", "to_node").alias("hi"), "twin",
        F.array_min(ys).alias("lat_min"), F.array_max(ys).alias("lat_max"), F.array_min(xs).alias("lon_min"), F.array_max(xs).alias("lon_max"),
    )


def with_typical_speeds(edges: DataFrame, typical: Mapping[str, float]) -> DataFrame:
    return edges.withColumn("typ_ms", geo.typical_speed(F.col("road_class"), typical))


def _crosses(box: list[Column]) -> Column:
    """Whether a polyline meets the box (lat_lo, lat_hi, lon_lo, lon_hi): one leg does, by clipping it."""
    lat_lo, lat_hi, lon_lo, lon_hi = box

    def leg(a: Column, b: Column) -> Column:
        def span(p: Column, q: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
            d = q - p
            inside = (p >= lo) & (p <= hi)
            t0 = F.when(d != 0, F.least((lo - p) / d, (hi - p) / d)).otherwise(F.when(inside, 0.0).otherwise(2.0))
            t1 = F.when(d != 0, F.greatest((lo - p) / d, (hi - p) / d)).otherwise(F.when(inside, 1.0).otherwise(-1.0))
            return t0, t1

        x0, x1 = span(a["lon"], b["lon"], lon_lo, lon_hi)
        y0, y1 = span(a["lat"], b["lat"], lat_lo, lat_hi)
        return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))

    n = F.size("coords")
    return F.exists(F.zip_with(F.slice("coords", 1, F.greatest(n - 1, F.lit(0))), F.slice("coords", 2, F.greatest(n - 1, F.lit(0))), leg), lambda x: x)


def in_box(edges: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, buffer_m: float = DEFAULT.subgraph_buffer_m) -> DataFrame:
    """Edges that meet a padded box, with typical speeds by class and degrees counted anew. Box columns go to the scan, the exact test after it."""
    import math

    pad = buffer_m / geo.M_PER_DEGREE
    pad_lon = pad / max(1e-9, math.cos(math.radians((lat_min + lat_max) / 2)))
    lo, hi, left, right = lat_min - pad, lat_max + pad, lon_min - pad_lon, lon_max + pad_lon
    rows = edges.where((F.col("lat_max") >= lo) & (F.col("lat_min") <= hi) & (F.col("lon_max") >= left) & (F.col("lon_min") <= right))
    rows = rows.where(_crosses([F.lit(x) for x in (lo, hi, left, right)]))
    degrees = node_degrees(rows)
    rows = rows.drop("deg_to", "deg_from").join(degrees.select(F.col("node_id").alias("to_node"), F.col("degree").alias("deg_to")), "to_node").join(degrees.select(F.col("node_id").alias("from_node"), F.col("degree").alias("deg_from")), "from_node")
    return rows.withColumn("typ_ms", geo.typical_speed(F.col("road_class"))).select(*edges.columns)


def edge_boxes(edges: DataFrame, radius_m: float) -> DataFrame:
    """Edges with the box of points that could lie within the radius.

    A single leg comes as its start (a_lat, a_lon), way (dx, dy) and size2, the square of its degrees; other polylines as coords, with size2 null.
    """
    pad = radius_m / geo.M_PER_DEGREE * 1.001
    pad_lon = F.lit(pad) / F.greatest(F.lit(1e-6), F.cos(F.radians(F.greatest(F.abs("lat_min"), F.abs("lat_max")) + pad)))
    box = {"south": F.col("lat_min") - pad, "north": F.col("lat_max") + pad, "west": F.col("lon_min") - pad_lon, "east": F.col("lon_max") + pad_lon}
    one = F.size("coords") == 2
    a, b = F.get("coords", F.lit(0)), F.get("coords", F.lit(1))
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    leg = {"a_lat": a["lat"], "a_lon": a["lon"], "dx": dx, "dy": dy, "size2": dx * dx + dy * dy}
    return edges.select("link_id", "length_m", "lat_min", "lat_max", "lon_min", "lon_max", *(x.alias(n) for n, x in box.items()), *(F.when(one, x).alias(n) for n, x in leg.items()), F.when(one, F.lit(None)).otherwise(F.col("coords")).alias("coords"))


def _span(side: float, lo: str, hi: str) -> tuple[Column, Column]:
    return F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)


def edge_cells(boxes: DataFrame, side: float) -> DataFrame:
    """A row for each edge and cell (cy, cx) that its box touches."""
    return boxes.withColumn("cy", F.explode(F.sequence(*_span(side, "south", "north")))).withColumn("cx", F.explode(F.sequence(*_span(side, "west", "east"))))


def could_be_nearest(cells: DataFrame, side: float) -> DataFrame:
    """Without edges that are farther from every point of a cell than some other edge is from any of its points."""
    south, west = F.col("cy") * side, F.col("cx") * side
    # Degrees to a leg are convex, so they are most at a corner; metres are never more than a meridian's.
    corners = [(y, x) for y in (south, south + side) for x in (west, west + side)]

    def degrees(lat: Column, lon: Column) -> Column:
        t = geo.leg_share(*(F.col(c) for c in ("size2", "dx", "dy", "a_lat", "a_lon")), lat, lon)
        return F.hypot(F.col("a_lat") + t * F.col("dy") - lat, F.col("a_lon") + t * F.col("dx") - lon)

    most = F.when(F.col("size2") > 0, F.greatest(*(degrees(*c) for c in corners))).otherwise(F.lit(float("inf"))) * geo.M_PER_DEGREE
    zero = F.lit(0.0)
    gap_lat = F.greatest(zero, F.col("lat_min") - south - side, south - F.col("lat_max"))
    gap_lon = F.greatest(zero, F.col("lon_min") - west - side, west - F.col("lon_max"))
    narrow = F.greatest(zero, F.cos(F.radians(F.greatest(F.abs(south), F.abs(south + side)))))
    least = F.hypot(gap_lat, gap_lon * narrow) * geo.M_PER_DEGREE
    rows = cells.withColumn("__bound", F.min(most).over(Window.partitionBy("cy", "cx")))
    # A centimetre and a thousandth more than rounding can come to.
    return rows.where(least * 0.999 - 0.01 <= F.col("__bound")).drop("__bound")


def _shared_cells(edges: DataFrame, radius_m: float, nearest: bool) -> tuple[DataFrame, float]:
    """Edges by cell, broadcast if they are few enough, and the side of these cells."""
    boxes = kept(edge_boxes(edges, radius_m), "boxes")
    # Counted, not estimated: a plan of joins and explodes has no size of its own.
    rows = lambda side: F.sum((_span(side, "south", "north")[1] - _span(side, "south", "north")[0] + 1) * (_span(side, "west", "east")[1] - _span(side, "west", "east")[0] + 1))
    counts = boxes.agg(*(F.coalesce(rows(CELL / n), F.lit(0)) for n in PARTS)).first()
    for n, count in zip(PARTS, counts, strict=True):
        side = CELL / n
        if nearest and count <= 4 * BROADCAST_CELLS:
            few = kept(could_be_nearest(edge_cells(boxes, side), side), "cells")
            if few.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
                return F.broadcast(few), side
        if count <= BROADCAST_CELLS:
            return F.broadcast(edge_cells(boxes, side)), side
    return edge_cells(boxes, CELL), CELL


def _met(points: DataFrame, edges: DataFrame, radius_m: float, nearest: bool = False) -> DataFrame:
    """points with link_id, offset_m, perp_m of edges whose box holds them (nearest: that could be the nearest), or with nulls: a grid join, and plain arithmetic where the edge is a single leg. A point lies in one cell, so there are no repeats.

    An outer join, as tests of the distance would else be made within it, for all edges of a cell.
    """
    cells, side = _shared_cells(edges, radius_m, nearest)
    lat, lon = F.col("p.lat"), F.col("p.lon")
    inside = lat.between(F.col("e.south"), F.col("e.north")) & lon.between(F.col("e.west"), F.col("e.east"))
    rows = points.alias("p").join(cells.alias("e"), (F.floor(lat / side) == F.col("e.cy")) & (F.floor(lon / side) == F.col("e.cx")) & inside, "left")
    rows = rows.select(*(F.col(f"p.`{c}`") for c in points.columns), *(F.col(f"e.{c}").alias("link_id" if c == "link_id" else f"__{c}") for c in ("link_id", "length_m", "a_lat", "a_lon", "dx", "dy", "size2", "coords")))
    leg = [F.col(f"__{c}") for c in ("size2", "dx", "dy", "a_lat", "a_lon")]
    rows = rows.withColumn("__t", geo.leg_share(*leg, F.col("lat"), F.col("lon")))
    rows = rows.withColumns({"__x": F.col("__a_lon") + F.col("__t") * F.col("__dx"), "__y": F.col("__a_lat") + F.col("__t") * F.col("__dy"), "__s": F.sqrt("__size2")})
    rows = rows.withColumn("__line", F.when(F.col("__coords").isNotNull(), geo.projected(F.col("__coords"), F.col("__length_m"), F.col("lat"), F.col("lon"))))
    known = F.col("__s") > 0
    perp = F.when(known, geo.plane_m(F.col("lat"), F.col("lon"), F.col("__y"), F.col("__x"))).when(F.col("__s").isNull(), F.col("__line.perp_m")).otherwise(F.lit(float("inf")))
    offset = F.when(known, (F.lit(0.0) + F.col("__t") * F.col("__s")) / F.col("__s") * F.col("__length_m")).when(F.col("__s").isNull(), F.col("__line.offset_m")).otherwise(0.0)
    return rows.select(*points.columns, "link_id", offset.alias("offset_m"), perp.alias("perp_m"))


def near_edges(points: DataFrame, edges: DataFrame, radius_m: float) -> DataFrame:
    """points with link_id, offset_m, perp_m of every edge within the radius."""
    return _met(points, edges, radius_m).where(F.col("perp_m") <= radius_m)


def nearest_edge(points: DataFrame, edges: DataFrame, key: list[str], radius_m: float) -> DataFrame:
    """key with link_id, offset_m, perp_m of the nearest edge by (perp_m, link_id), null beyond the radius; a row for each key."""
    best = F.min(F.when(F.col("perp_m") <= radius_m, F.struct("perp_m", "link_id", "offset_m")))
    rows = _met(points.select(*key, "lat", "lon"), edges, radius_m, True).groupBy(*key).agg(best.alias("x"))
    return rows.select(*key, *(F.col(f"x.{c}").alias(c) for c in ("link_id", "offset_m", "perp_m")))


def project(points: DataFrame, edges: DataFrame, key: list[str], radius_m: float = 50.0, most: int = 5) -> DataFrame:
    """The nearest edges of each point, by (perp_m, link_id), as rank 0..most-1."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("perp_m", "link_id"))
    return near_edges(points, edges, radius_m).withColumn("rank", rank).where(F.col("rank") <= most).withColumn("rank", F.col("rank") - 1)


def project_widening(points: DataFrame, edges: DataFrame, key: list[str], radius_m: float = DEFAULT.candidate_radius_m, most: int = DEFAULT.max_state_candidates, max_radius_m: float = DEFAULT.candidate_max_radius_m) -> DataFrame:
    """As project(), with the radius doubled until an edge is met: one pass at the largest, then the smallest ring that has a hit."""
    rings, r = [radius_m], radius_m
    while r < max_radius_m:
        r = min(2 * r, max_radius_m)
        rings.append(r)
    # Rows of a point come one after the other, so the least distance needs no sort, and fewer are left to be ranked.
    own = Window.partitionBy(*key)
    rows = near_edges(points, edges, rings[-1]).withColumn("__least", F.min("perp_m").over(own))
    rows = rows.where(F.col("perp_m") <= F.coalesce(*(F.when(F.col("__least") <= x, F.lit(x)) for x in rings))).drop("__least")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("perp_m", "link_id")) - 1)
    return rows.where(F.col("rank") < most)


def perpendicular(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (lat, lon, link_id, offset_m) with distance_m to the point at the offset; infinite for unknown or degenerate edges."""
    own = edges.select("link_id", "coords", F.col("length_m").alias("__len"))
    joined = rows.join(own, "link_id", "left").withColumn("__at", geo.point_at(F.col("coords"), F.col("__len"), F.col("offset_m")))
    ok = (F.col("__len") > 0) & (geo.line_degrees(F.col("coords")) > 0)
    return joined.withColumn("distance_m", F.when(ok, geo.plane_m(F.col("lat"), F.col("lon"), F.col("__at.lat"), F.col("__at.lon"))).otherwise(F.lit(float("inf")))).drop("coords", "__len", "__at")


def state_positions(states: DataFrame, edges: DataFrame) -> DataFrame:
    """states with lat, lon on the edge; null for unknown or degenerate edges."""
    own = edges.select("link_id", "coords", F.col("length_m").alias("__len"))
    at = F.when((F.col("__len") > 0) & (geo.line_degrees(F.col("coords")) > 0), geo.point_at(F.col("coords"), F.col("__len"), F.col("offset_m")))
    return states.join(own, "link_id", "left").withColumn("__at", at).withColumns({"lat": F.col("__at.lat"), "lon": F.col("__at.lon")}).drop("coords", "__len", "__at")


def route_key(keys: Column) -> Column:
    """Undirected keys (strings) without repeats in a row: the physical route."""
    return F.array_join(F.filter(F.transform(keys, lambda x, i: F.when((i == 0) | (F.get(keys, i - 1) != x), x)), lambda x: x.isNotNull()), ">")


def diverse_rank(group: list[str], route: str, order: list[str]) -> Column:
    """Place of a path when each route's best path comes before all second ones; paths without a route count as routes of their own."""
    within = F.row_number().over(Window.partitionBy(*group, route).orderBy(*order))
    return F.when(F.col(route).isNull(), 1).otherwise(within)


def polyline(paths: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, line: the driven geometry of paths (edges, mask, start_offset, end_offset, off_road), at least two points.

    The first and last edges are cut at the offsets, reversed edges are turned, repeats in a row go.
    """
    own = edges.select("link_id", "coords", F.col("length_m").alias("__len"))
    rows = paths.select(*key, "start_offset", "end_offset", "off_road", "mask", F.size("edges").alias("n"), F.posexplode("edges").alias("i", "link_id")).join(own, "link_id")
    rev = F.coalesce(F.get("mask", F.col("i")), F.lit(False))
    first, last = F.col("i") == 0, F.col("i") == F.col("n") - 1
    a = F.when(first, F.col("start_offset")).otherwise(F.when(rev, F.col("__len")).otherwise(0.0))
    b = F.when(last, F.col("end_offset")).otherwise(F.when(rev, 0.0).otherwise(F.col("__len")))
    lo, hi = F.least(a, b), F.greatest(a, b)
    c, size = F.col("coords"), F.col("__len")
    # Inner points with their place along the edge.
    places = F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.array(F.lit(0.0)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.sqrt(F.pow(F.get(c, i)["lon"] - F.get(c, i - 1)["lon"], 2) + F.pow(F.get(c, i)["lat"] - F.get(c, i - 1)["lat"], 2)))))
    degrees = geo.line_degrees(c)
    inner = F.filter(F.zip_with(c, places, lambda p, d: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), (d / degrees * size).alias("m"))), lambda x: (x["m"] > lo) & (x["m"] < hi))
    inner = F.transform(F.when(a > b, F.reverse(inner)).otherwise(inner), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    whole = F.concat(F.array(geo.point_at(c, size, a)), inner, F.array(geo.point_at(c, size, b)))
    ends = F.array(geo.point_at(c, size, F.when(first, F.col("start_offset")).otherwise(F.col("end_offset"))))
    rows = rows.withColumn("part", F.when(F.col("off_road"), ends).otherwise(whole))
    line = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]))
    rows = rows.groupBy(*key).agg(line.alias("line"))
    kept = F.filter(F.transform("line", lambda p, i: F.when((i == 0) | (F.get("line", i - 1) != p), p)), lambda p: p.isNotNull())
    return rows.withColumn("line", kept).withColumn("line", F.when(F.size("line") == 1, F.concat("line", "line")).otherwise(F.col("line")))
