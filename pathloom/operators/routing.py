"""Routes on the road graph.

Search is set at a time: state pairs are rows, routes are computed once for each distinct pair
of boundary nodes (many state pairs share one) and joined back. Only that search runs in Python,
on a graph that is broadcast when it has at most BROADCAST_EDGES edges, and dealt by region
with its requests beyond that.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.config import Config
from pathloom.functions import geo
from pathloom.sources.work import kept

BROADCAST_EDGES = 2_000_000
FASTEST_MS = 60.0
DEFAULT = Config()
ROUTE_SCHEMA = "exit_node long, entry_node long, route int, worst double, mid_links array<long>, mid_reversed array<boolean>, mid_m double, mid_typ_s double, mid_min_s double"


def arcs(edges: DataFrame, violations: bool = False, cost_factor: float = DEFAULT.direction_violation_cost_factor) -> DataFrame:
    """u, v, link_id, weight (typical time), fastest (at the cap), illegal: one arc for each node pair, the cheapest by weight.

    With violations, one-way edges that won their pair also give an arc backwards, dearer by the factor, where no legal arc runs.
    """
    usable = edges.where("length_m > 0 and typ_ms > 0 and max_ms > 0")
    legal = usable.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), "link_id", (F.col("length_m") / F.col("typ_ms")).alias("weight"), (F.col("length_m") / F.col("max_ms")).alias("fastest"), "length_m", F.col("twin").isNull().alias("oneway"))
    best = legal.groupBy("u", "v").agg(F.min_by(F.struct("link_id", "weight", "fastest", "length_m", "oneway"), F.struct("weight", "link_id")).alias("x")).select("u", "v", "x.*").withColumn("illegal", F.lit(False))
    if violations:
        back = best.where("oneway and u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "link_id", (F.col("weight") * cost_factor).alias("weight"), "fastest", "length_m", "oneway", F.lit(True).alias("illegal"))
        best = best.unionByName(back.join(best.select("u", "v"), ["u", "v"], "left_anti"))
    return best.drop("oneway")


class Graph:
    """Arcs by tail node, for searches in a worker."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["u", "v"], kind="stable")
        self.out: dict[int, list[tuple[int, int, float, float]]] = {}
        self.arc: dict[tuple[int, int], tuple] = {}
        for r in rows.itertuples(index=False):
            self.out.setdefault(r.u, []).append((r.v, r.link_id, r.weight, r.fastest))
            self.arc[r.u, r.v] = (r.link_id, r.illegal, r.length_m, r.weight, r.fastest)

    def cheapest(self, source: int, target: int, surcharge: dict[tuple[int, int], float], most: float = float("inf")) -> list[int] | None:
        """Nodes of the cheapest route under surcharged weights; None beyond `most`."""
        best, via, heap, done = {source: 0.0}, {}, [(0.0, source)], set()
        while heap:
            cost, node = heapq.heappop(heap)
            if node in done:
                continue
            if node == target:
                route = [node]
                while node != source:
                    node = via[node]
                    route.append(node)
                return route[::-1]
            if cost > most:
                return None
            done.add(node)
            for to, _, weight, _ in self.out.get(node, ()):
                new = cost + weight * surcharge.get((node, to), 1.0)
                if new < best.get(to, float("inf")):
                    best[to], via[to] = new, node
                    heapq.heappush(heap, (new, to))
        return None

    def diverse(self, source: int, target: int, most: float, k: int, penalty: float) -> Iterator[list[int]]:
        """Up to k routes of at most `most` weight; each surcharges its arcs for the next ones."""
        surcharge: dict[tuple[int, int], float] = {}
        for n in range(k):
            route = self.cheapest(source, target, surcharge, most * (1 + penalty) ** n + 1e-9)
            if route is None or sum(self.arc[a][3] for a in zip(route, route[1:], strict=False)) > most:
                return
            yield route
            for a in zip(route, route[1:], strict=False):
                surcharge[a] = surcharge.get(a, 1.0) * (1 + penalty)

    def times(self, source: int, most: float) -> dict[int, float]:
        """Least time at the caps to every node within `most`."""
        best, heap, done = {source: 0.0}, [(0.0, source)], {}
        while heap:
            cost, node = heapq.heappop(heap)
            if node in done or cost > most:
                continue
            done[node] = cost
            for to, _, _, fastest in self.out.get(node, ()):
                if cost + fastest < best.get(to, float("inf")):
                    best[to] = cost + fastest
                    heapq.heappush(heap, (cost + fastest, to))
        return done


def _searched(rows: pd.DataFrame, graph: Graph, k: int, penalty: float) -> pd.DataFrame:
    out = []
    for r in rows.itertuples(index=False):
        worst = 0.0
        for n, route in enumerate(graph.diverse(r.exit_node, r.entry_node, r.cap, k, penalty)):
            arcs_ = [graph.arc[a] for a in zip(route, route[1:], strict=False)]
            worst = max(worst, sum(a[3] for a in arcs_))
            links = [a[0] for a in arcs_]
            out.append((r.exit_node, r.entry_node, n, worst, links, [bool(a[1]) for a in arcs_], sum(a[2] for a in arcs_), 0.0, sum(a[4] for a in arcs_)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ROUTE_SCHEMA.split(", ")])


def _shared_graph(table: DataFrame) -> Callable[[], Graph] | None:
    """A broadcast graph if it is small enough."""
    rows = table.select("u", "v", "link_id", "weight", "fastest", "length_m", "illegal").limit(BROADCAST_EDGES + 1).toPandas()
    if len(rows) > BROADCAST_EDGES:
        return None
    shared, held = table.sparkSession.sparkContext.broadcast(rows), {}

    def graph() -> Graph:
        if "g" not in held:
            held["g"] = Graph(shared.value)
        return held["g"]

    return graph


def diverse_routes(requests: DataFrame, edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Routes (ROUTE_SCHEMA) for requests (exit_node, entry_node, cap[, region]). worst: the largest weight up to this route, so a request of a smaller cap takes routes with worst <= cap.

    Beyond BROADCAST_EDGES the requests need a region, and edges a region with all edges that its routes may use.
    """
    regional = "region" in requests.columns
    key = ["region"] if regional else []
    wanted = requests.groupBy(*key, "exit_node", "entry_node").agg(F.max("cap").alias("cap"))
    k, penalty = cfg.paths_per_pair, cfg.path_penalty_lambda
    table = arcs(edges, cfg.enable_direction_violation, cfg.direction_violation_cost_factor)
    if not regional:
        graph = _shared_graph(table)
        if graph is None:
            raise ValueError(f"over {BROADCAST_EDGES} edges: give requests and edges a region")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield _searched(rows, graph(), k, penalty)

        found = kept(wanted.repartition("exit_node", "entry_node").mapInPandas(run, ROUTE_SCHEMA), "routes")
    else:
        by_region = edges.select("region").distinct().join(edges, "region")
        legal = by_region.where("length_m > 0").select("region", F.col("from_node").alias("u"), F.col("to_node").alias("v"), "link_id", (F.col("length_m") / F.col("typ_ms")).alias("weight"), (F.col("length_m") / F.col("max_ms")).alias("fastest"), "length_m", F.lit(False).alias("illegal"))

        def pair(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values(["weight", "link_id"]).drop_duplicates(["u", "v"])
            return _searched(left, Graph(right), k, penalty) if len(left) and len(right) else _searched(left[:0], None, k, penalty)

        found = wanted.groupBy("region").cogroup(legal.groupBy("region")).applyInPandas(pair, ROUTE_SCHEMA)
    # Travel time at typical speeds comes from the links: weights of illegal arcs carry the surcharge.
    own = edges.select("link_id", (F.col("length_m") / F.col("typ_ms")).alias("t")).distinct()
    sums = found.select("exit_node", "entry_node", "route", F.explode("mid_links").alias("link_id")).join(own, "link_id").groupBy("exit_node", "entry_node", "route").agg(F.sum("t").alias("t"))
    return found.drop("mid_typ_s").join(sums, ["exit_node", "entry_node", "route"])


def node_times(pairs: DataFrame, edges: DataFrame, weight: str = "fastest") -> DataFrame:
    """pairs (from_node, to_node) with time_s along legal arcs, by weight or fastest time; infinite if there is no way."""
    table = arcs(edges)
    graph = _shared_graph(table.withColumn("fastest", F.col(weight)))
    if graph is None:
        raise ValueError(f"over {BROADCAST_EDGES} edges: cut them by in_box() first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for source, part in rows.groupby("from_node"):
                found = graph().times(source, float("inf"))
                out.append(part.assign(time_s=[found.get(x, np.inf) for x in part["to_node"]]))
            yield pd.concat(out) if out else rows.assign(time_s=0.0)

    wanted = pairs.select("from_node", "to_node").distinct().repartition("from_node").sortWithinPartitions("from_node")
    return wanted.mapInPandas(run, "from_node long, to_node long, time_s double")


def shortest_times(points: DataFrame, edges: DataFrame, key: list[str], factor: float = 1.0, radius_m: float = 200.0) -> DataFrame:
    """key and min_travel_s between (lat, lon) and (to_lat, to_lon): a lower bound at the caps, from nearest edge to nearest edge.

    Forward on one edge it is the offset's share; otherwise the rest of the first edge, the graph, and the beginning of the last. Infinite without a nearby edge or a way.
    """
    from pathloom.operators.network import nearest_edge

    side = lambda end, lat, lon: F.struct(F.lit(end).alias("end"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    both = points.select(*key, F.explode(F.array(side("a", "lat", "lon"), side("b", "to_lat", "to_lon"))).alias("x")).select(*key, F.col("x.end").alias("__end"), "x.lat", "x.lon")
    near = nearest_edge(both, edges, [*key, "__end"], radius_m).join(edges.select("link_id", "from_node", "to_node", F.col("length_m").alias("len"), F.col("max_ms").alias("v")), "link_id", "left")
    names = ("link_id", "offset_m", "from_node", "to_node", "len", "v")
    at = {f"{end}_{c}": F.max(F.when(F.col("__end") == end, F.col(c))) for end in "ab" for c in names}
    rows = kept(near.groupBy(*key).agg(*(x.alias(n) for n, x in at.items())), "ends")
    times = node_times(rows.where("a_link_id is not null and b_link_id is not null").select(F.col("a_to_node").alias("from_node"), F.col("b_from_node").alias("to_node")), edges)
    rows = rows.join(times.select(F.col("from_node").alias("a_to_node"), F.col("to_node").alias("b_from_node"), "time_s"), ["a_to_node", "b_from_node"], "left")
    forward = (F.col("a_link_id") == F.col("b_link_id")) & (F.col("b_offset_m") >= F.col("a_offset_m"))
    round_ = (F.col("a_len") - F.col("a_offset_m")) / F.col("a_v") + F.col("time_s") + F.col("b_offset_m") / F.col("b_v")
    out = F.when(forward, (F.col("b_offset_m") - F.col("a_offset_m")) / F.col("a_v")).otherwise(round_) / factor
    return rows.select(*key, F.coalesce(out, F.lit(float("inf"))).alias("min_travel_s"))


def _with_edge(rows: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    own = edges.select(F.col("link_id").alias(f"{end}_link"), *(F.col(c).alias(f"{end}_{n}") for c, n in (("from_node", "from"), ("to_node", "to"), ("length_m", "len"), ("typ_ms", "typ"), ("max_ms", "max"), ("coords", "coords"))), F.col("twin").isNull().alias(f"{end}_oneway"))
    return rows.join(own, f"{end}_link")


def candidate_paths(states: DataFrame, transitions: DataFrame, edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Paths of each transition (trip_id, k, budget_s) between its states (trip_id, k, rank, link_id, offset_m, perp_m), cut to the best and numbered.

    trip_id, k, path_id, edges, mask, start_offset, end_offset, ett_s, length_m, min_s, budget_s, start_perp, end_perp, off_road
    """
    from pathloom.operators.candidates import route_and_features

    a = states.select("trip_id", "k", *(F.col(c).alias(f"a_{n}") for c, n in (("rank", "rank"), ("link_id", "link"), ("offset_m", "off"), ("perp_m", "perp"))))
    b = states.select("trip_id", (F.col("k") - 1).alias("k"), *(F.col(c).alias(f"b_{n}") for c, n in (("rank", "rank"), ("link_id", "link"), ("offset_m", "off"), ("perp_m", "perp"))))
    pairs = transitions.where("budget_s is not null").select("trip_id", "k", "budget_s").join(a, ["trip_id", "k"]).join(b, ["trip_id", "k"])
    pairs = _with_edge(_with_edge(pairs, edges, "a"), edges, "b").withColumn("limit", F.col("budget_s") * cfg.path_budget_slack)
    pairs = kept(pairs, "pairs")
    keep = ["trip_id", "k", "budget_s", "limit", "a_rank", "b_rank", "a_link", "b_link", "a_off", "b_off", "a_perp", "b_perp"]
    no_links, no_flags = F.array().cast("array<long>"), F.array().cast("array<boolean>")
    violation = F.lit(cfg.enable_direction_violation)

    # On one edge: staying or going on, and rolling back against a one-way.
    gap = F.col("b_off") - F.col("a_off")
    moves = F.array(F.struct(F.lit(0).alias("option"), F.greatest(gap, F.lit(0.0)).alias("m"), F.lit(False).alias("rev")), F.when(violation & F.col("a_oneway") & (gap < 0), F.struct(F.lit(1).alias("option"), (-gap).alias("m"), F.lit(True).alias("rev"))))
    same = pairs.where("a_link = b_link").withColumn("x", F.explode(F.filter(moves, lambda x: x.isNotNull())))
    same = same.select(*keep, F.col("x.option").alias("option"), F.lit(0).alias("route"), F.array("a_link").alias("edges"), F.array("x.rev").alias("mask"), F.col("x.m").alias("length_m"), (F.col("x.m") / F.col("a_typ")).alias("ett_s"), (F.col("x.m") / F.col("a_max")).alias("min_s"))

    # Between edges: leave by the end (or back by the start of a one-way), enter by the start (or by the end).
    side = lambda node, span, rev, option: F.struct(F.col(node).alias("node"), span.alias("m"), F.lit(rev).alias("rev"), F.lit(option).alias("option"))
    exits = F.array(side("a_to", F.col("a_len") - F.col("a_off"), False, 0), F.when(violation & F.col("a_oneway"), side("a_from", F.col("a_off"), True, 2)))
    entries = F.array(side("b_from", F.col("b_off"), False, 0), F.when(violation & F.col("b_oneway"), side("b_to", F.col("b_len") - F.col("b_off"), True, 1)))
    known = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    other = pairs.where("a_link <> b_link").withColumn("x", F.explode(known(exits))).withColumn("y", F.explode(known(entries)))
    ends = lambda v: F.col("x.m") / F.col(f"a_{v}") + F.col("y.m") / F.col(f"b_{v}")
    other = other.withColumns({"typ_s": ends("typ"), "ends_s": ends("max"), "ends_m": F.col("x.m") + F.col("y.m"), "option": F.col("x.option") + F.col("y.option"), "exit_node": F.col("x.node"), "entry_node": F.col("y.node")}).where("ends_s <= limit")
    other = other.withColumn("cap", F.greatest(3 * (F.col("limit") - F.col("ends_s")), F.lit(0.1)))

    def path(rows: DataFrame, links, flags, m, typ_s, min_s, route) -> DataFrame:
        mask = F.concat(F.array("x.rev"), flags, F.array("y.rev"))
        return rows.select(*keep, "option", route.alias("route"), F.concat(F.array("a_link"), links, F.array("b_link")).alias("edges"), mask.alias("mask"), (F.col("ends_m") + m).alias("length_m"), (F.col("typ_s") + typ_s).alias("ett_s"), (F.col("ends_s") + min_s).alias("min_s"))

    adjacent = path(other.where("exit_node = entry_node"), no_links, no_flags, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0))
    apart = other.where("exit_node <> entry_node")
    routes = kept(diverse_routes(apart.select("exit_node", "entry_node", "cap"), edges, cfg), "routes")
    routed = path(apart.join(routes, ["exit_node", "entry_node"]).where("worst <= cap"), F.col("mid_links"), F.col("mid_reversed"), F.col("mid_m"), F.col("t"), F.col("mid_min_s"), F.col("route"))
    every = same.unionByName(adjacent).unionByName(routed).where("min_s <= limit")
    every = every.withColumn("mask", F.when(F.exists("mask", lambda x: x), F.col("mask"))).withColumn("off_road", F.lit(False))
    every = kept(every, "paths")

    if cfg.enable_offroad:
        every = every.unionByName(_off_road(pairs, every, cfg).select(*every.columns))
    # All that is counted within a transition needs this one shuffle.
    every = every.repartition("trip_id", "k")
    # Of paths with the same links and directions the fastest stays; off-road ones replace equals if shorter.
    order = [F.when(F.col("off_road"), F.col("length_m")).otherwise(F.lit(0.0)), "ett_s", "a_rank", "b_rank", "option", "route"]
    first = F.row_number().over(Window.partitionBy("trip_id", "k", "edges", "mask", "off_road").orderBy(*order))
    best = every.withColumn("__n", first).where("__n = 1").drop("__n")
    spelled = Window.partitionBy("trip_id", "k", "edges", "mask")
    best = best.withColumn("__n", F.row_number().over(spelled.orderBy("length_m", "off_road"))).withColumn("__c", F.count("*").over(spelled)).where("__c = 1 or __n = 1").drop("__n", "__c")
    best = best.select("trip_id", "k", "edges", "mask", F.col("a_off").alias("start_offset"), F.col("b_off").alias("end_offset"), "ett_s", "length_m", "min_s", "budget_s", F.col("a_perp").alias("start_perp"), F.col("b_perp").alias("end_perp"), "off_road", F.struct("a_rank", "b_rank", "option", "route").alias("made"))
    best = best.withColumn("path_id", F.row_number().over(Window.partitionBy("trip_id", "k").orderBy("ett_s", "made", "off_road")) - 1)
    full = route_and_features(kept(best, "best"), edges, ["trip_id", "k", "path_id"]).repartition("trip_id", "k")
    if cfg.diversify_truncation:
        from pathloom.operators.network import diverse_rank

        full = full.withColumn("__r", F.when(diverse_rank(["trip_id", "k"], "route", ["ett_s", "path_id"]) == 1, 0).otherwise(1))
        place = F.row_number().over(Window.partitionBy("trip_id", "k").orderBy("__r", "ett_s", "path_id"))
    else:
        place = F.row_number().over(Window.partitionBy("trip_id", "k").orderBy("ett_s", "path_id"))
    return full.withColumn("__p", place).where(F.col("__p") <= cfg.max_path_candidates).drop("__p", "__r", "made")


def _off_road(pairs: DataFrame, routed: DataFrame, cfg: Config) -> DataFrame:
    """Straight candidates where the shortest routed way is a long and slow detour for a short gap."""
    least = routed.where("a_link <> b_link").groupBy("trip_id", "k", "a_link", "b_link").agg(F.min(F.struct("length_m", "a_rank", "b_rank", "option", "route", "ett_s")).alias("r"))
    rows = pairs.where("a_link <> b_link").join(least, ["trip_id", "k", "a_link", "b_link"])
    at = lambda e: geo.point_at(F.col(f"{e}_coords"), F.col(f"{e}_len"), F.col(f"{e}_off"))
    rows = rows.withColumn("pa", at("a")).withColumn("pb", at("b")).withColumn("length_m", geo.plane_m(F.col("pa.lat"), F.col("pa.lon"), F.col("pb.lat"), F.col("pb.lon")))
    one = F.lit(1.0)
    gates = (F.col("length_m") < cfg.offroad_max_straight_m) & (F.col("r.length_m") >= cfg.offroad_min_detour_ratio * F.greatest("length_m", one)) & (F.col("r.ett_s") > cfg.offroad_min_overslack * F.greatest("budget_s", one))
    speed = F.greatest(one, F.least("a_typ", "b_typ"))
    return rows.where(gates).withColumns({"option": F.lit(9), "route": F.lit(0), "edges": F.array("a_link", "b_link"), "mask": F.lit(None).cast("array<boolean>"), "ett_s": F.col("length_m") / speed, "min_s": F.col("length_m") / FASTEST_MS, "off_road": F.lit(True)})
