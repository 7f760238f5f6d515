"""State candidates, path features and log potentials, as relational expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.config import CLASS_SLOTS, N_FEATURES, Config
from pathloom.functions import geo
from pathloom.operators import network
from pathloom.sources.work import kept

DEFAULT = Config()
TOUCH_M = 1.0


def state_candidates(obs: DataFrame, edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """trip_id, k, rank, link_id, offset_m, perp_m for each observation (trip_id, k, lat, lon) near a road."""
    rows = network.project_widening(obs.select("trip_id", "k", "lat", "lon"), edges, ["trip_id", "k"], cfg.candidate_radius_m, cfg.max_state_candidates, cfg.candidate_max_radius_m)
    return rows.select("trip_id", "k", "rank", "link_id", "offset_m", "perp_m")


# Path accessors


def inferred_dwell(budget: Column, ett: Column) -> Column:
    return F.greatest(F.lit(0.0), budget - ett)


def slack_deficit(budget: Column, ett: Column) -> Column:
    return F.greatest(F.lit(0.0), ett - budget)


def is_overslacked(budget: Column, ett: Column) -> Column:
    return ett > budget


def n_violations(mask: Column) -> Column:
    return F.coalesce(F.size(F.filter(mask, lambda x: x)), F.lit(0)) * F.when(mask.isNull(), 0).otherwise(1)


def edge_reversed(mask: Column, i: Column) -> Column:
    return F.coalesce(F.get(mask, i), F.lit(False))


def touches(link: Column, offset: Column, state_link: Column, state_offset: Column) -> Column:
    """A path's end lies at a state: same link, less than a metre apart."""
    return (link == state_link) & (F.abs(offset - state_offset) < TOUCH_M)


def route_and_features(paths: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """paths with route (canonical key string, null off road) and phi (array of N_FEATURES).

    One join and one grouping by shape: paths of equal edges, mask and off_road share what these
    give, and a road network has far fewer shapes than trips have paths. What depends on
    neighbours is read from the ordered array. Links that the network lacks are left out.
    """
    shape = ["edges", "mask", "off_road"]
    shapes = kept(paths.select(*shape).distinct().withColumn("__shape", F.monotonically_increasing_id()), "shapes")
    own = edges.select("link_id", "road_class", F.col("length_m").alias("len"), "entry_deg", "exit_deg", "signal", "stop", "deg_from", "deg_to", "lo", "hi")
    rows = shapes.select("__shape", "mask", F.posexplode("edges").alias("i", "link_id")).join(own, "link_id")
    rev = edge_reversed(F.col("mask"), F.col("i"))
    slot = F.coalesce(*(F.when(F.col("road_class").isin([c for c, s in CLASS_SLOTS.items() if s == x]), x) for x in sorted(set(CLASS_SLOTS.values()))))
    leg = F.struct(
        "i", rev.alias("rev"), slot.alias("slot"), "len", geo.driven_entry(F.col("entry_deg"), F.col("exit_deg"), rev).alias("entry"), geo.driven_exit(F.col("entry_deg"), F.col("exit_deg"), rev).alias("exit"),
        "signal", "stop", F.when(rev, F.col("deg_from")).otherwise(F.col("deg_to")).alias("degree"), F.concat_ws("-", "lo", "hi").alias("seg"),
    )
    legs = rows.groupBy("__shape").agg(F.array_sort(F.collect_list(leg)).alias("__legs"))
    full = shapes.join(legs, "__shape", "left")
    x, road = F.col("__legs"), ~F.col("off_road")
    # A leg and the next one, at each joint.
    n = F.coalesce(F.greatest(F.size(x) - 1, F.lit(0)), F.lit(0))
    full = full.withColumn("__joints", F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: F.struct(geo.turn_deg(a["exit"], b["entry"]).alias("turn"), a["signal"].alias("signal"), a["stop"].alias("stop"), a["rev"].alias("rev"), a["degree"].alias("degree"))))
    count = lambda test: F.when(road, F.coalesce(F.size(F.filter(F.col("__joints"), test)), F.lit(0)).cast("double")).otherwise(0.0)
    full = full.withColumn("__whole", geo.total(F.transform(x, lambda a: a["len"])))
    whole = F.col("__whole")

    def share(s: int) -> Column:
        of = F.filter(x, lambda a: a["slot"] == s)
        on = F.when(whole > 0, geo.total(F.transform(of, lambda a: a["len"])) / whole).otherwise(0.0)
        return F.coalesce(F.when(road, on).otherwise(F.size(of) * 0.5), F.lit(0.0))

    dwell = inferred_dwell(F.col("budget_s"), F.col("ett_s"))
    of_shape = {
        1: count(lambda j: j["turn"] <= -geo.TURN_DEGREES), 2: count(lambda j: j["turn"] >= geo.TURN_DEGREES),
        3: count(lambda j: j["signal"] & ~j["rev"]), 4: count(lambda j: j["stop"] & ~j["rev"]), **{s: share(s) for s in range(5, 12)},
        17: count(lambda j: j["degree"] >= 3), 18: F.when(road, geo.true_runs(F.transform(x, lambda a: a["rev"])).cast("double")).otherwise(0.0),
    }
    of_path = {
        0: F.col("length_m") / 1000, 12: F.col("ett_s") / 60, 13: dwell / 60, 14: F.when(F.col("budget_s") > 0, dwell / F.col("budget_s")).otherwise(0.0),
        15: F.col("start_perp") / 10, 16: F.col("end_perp") / 10,
    }
    route = F.when(road, F.coalesce(network.route_key(F.transform(x, lambda a: a["seg"])), F.lit("")))
    known = full.select(*(F.col(c).alias(f"__{c}") for c in shape), F.struct(*(c.alias(f"f{i}") for i, c in of_shape.items())).alias("__phi"), route.alias("route"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shape]
    phi = of_path | {i: F.col(f"__phi.f{i}") for i in of_shape}
    rows = paths.join(known, same[0] & same[1] & same[2], "left")
    return rows.select(*paths.columns, F.array(*(F.coalesce(phi[i], F.lit(0.0)) for i in range(N_FEATURES))).alias("phi"), "route")


def emissions(states: DataFrame, obs: DataFrame, edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """states with log_e: the density of the distance from observation to the state's point."""
    rows = network.perpendicular(states.join(obs.select("trip_id", "k", "lat", "lon"), ["trip_id", "k"]), edges)
    return rows.withColumn("log_e", geo.log_student_t(F.col("distance_m"), cfg.emission_scale, cfg.emission_df)).drop("lat", "lon")


def dot(phi: Column, mu: tuple[float, ...]) -> Column:
    return F.aggregate(F.zip_with(phi, F.array(*map(F.lit, mu)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def transition_cells(paths: DataFrame, states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """trip_id, k, i, j, path_id, log_p: the cells (state i at k, state j at k + 1) that each path joins; impossible ones are left out."""
    mu = cfg.mu()
    rows = paths.select("trip_id", "k", "path_id", "start_offset", "end_offset", F.col("edges")[0].alias("first"), F.element_at("edges", -1).alias("last"), dot(F.col("phi"), mu).alias("log_p")).where("log_p > double('-Infinity')")
    a = states.select("trip_id", "k", F.col("rank").alias("i"), F.col("link_id").alias("first"), F.col("offset_m").alias("__a"))
    b = states.select("trip_id", (F.col("k") - 1).alias("k"), F.col("rank").alias("j"), F.col("link_id").alias("last"), F.col("offset_m").alias("__b"))
    rows = rows.join(a, ["trip_id", "k", "first"]).where(F.abs(F.col("start_offset") - F.col("__a")) < TOUCH_M)
    rows = rows.join(b, ["trip_id", "k", "last"]).where(F.abs(F.col("end_offset") - F.col("__b")) < TOUCH_M)
    return rows.select("trip_id", "k", "i", "j", "path_id", "log_p")


def cell_matrix(cells: DataFrame, key: list[str]) -> DataFrame:
    """For each cell (key, i, j) log_sum (log of summed weights), log_max and best_path (ties: the smallest)."""
    rows = cells.withColumn("log_max", F.max("log_p").over(Window.partitionBy(*key, "i", "j")))
    return rows.groupBy(*key, "i", "j").agg((F.first("log_max") + F.log(F.sum(F.exp(F.col("log_p") - F.col("log_max"))))).alias("log_sum"), F.max("log_p").alias("log_max"), F.max_by("path_id", F.struct("log_p", -F.col("path_id"))).alias("best_path"))
