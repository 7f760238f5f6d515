"""The end-to-end query: raw pings and a road network to probable states, routes and positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.config import Config
from pathloom.functions import geo
from pathloom.operators import candidates, inference, network, preprocess, routing
from pathloom.sources.work import kept

DEFAULT = Config()


@dataclass
class Reconstruction:
    """Tables of a run, each keyed by trip_id and k."""

    obs: DataFrame
    states: DataFrame
    paths: DataFrame
    cells: DataFrame
    inferred: DataFrame
    edges: DataFrame

    def state_marginals(self) -> DataFrame:
        """trip_id, seg, k, link_id, offset_m, prob."""
        rows = self.inferred.join(self.states.withColumnRenamed("rank", "i"), ["trip_id", "k", "i"])
        return rows.select("trip_id", "seg", "k", "link_id", "offset_m", "perp_m", "prob", "mle")

    def path_marginals(self) -> DataFrame:
        return inference.path_marginals(self.inferred, self.cells)

    def most_likely(self) -> DataFrame:
        """trip_id, seg, k, link_id, offset_m and the path on from there (null at a segment's end)."""
        best = self.inferred.where("mle").join(self.states.withColumnRenamed("rank", "i"), ["trip_id", "k", "i"])
        own = self.paths.select("trip_id", "k", F.col("path_id").alias("mle_path"), "edges", "mask", "ett_s", "length_m", F.col("budget_s").alias("path_budget_s"), "off_road")
        return best.join(own, ["trip_id", "k", "mle_path"], "left").select("trip_id", "seg", "k", "link_id", "offset_m", "mle_path", "edges", "mask", "ett_s", "length_m", "path_budget_s", "off_road")

    def segments(self) -> DataFrame:
        """trip_id, seg, k_first, k_last, n, log_z, stale_fraction, replay_dropped and what lies before the segment."""
        span = self.inferred.groupBy("trip_id", "seg").agg(F.min("k").alias("k_first"), F.max("k").alias("k_last"), F.max("log_z").alias("log_z"), F.max("cliff").alias("cliff"))
        own = span.join(self.obs.where("not replayed").select("trip_id", "k", "t_first", "t_last", "stale"), "trip_id").where("k between k_first and k_last")
        own = own.groupBy("trip_id", "seg").agg(F.count("*").alias("n"), F.avg(F.col("stale").cast("double")).alias("stale_fraction"), F.min("t_first").alias("t_from"), F.max("t_first").alias("t_to"))
        lost = self.obs.where("replayed").select("trip_id", F.col("t_first").alias("__t"))
        dropped = own.join(lost, "trip_id").where("__t between t_from and t_to").groupBy("trip_id", "seg").agg(F.count("*").alias("replay_dropped"))
        rows = span.join(own, ["trip_id", "seg"]).join(dropped, ["trip_id", "seg"], "left").withColumn("replay_dropped", F.coalesce("replay_dropped", F.lit(0).cast("long")))
        return rows

    def discontinuities(self) -> DataFrame:
        """For each segment but a trip's first: gap_s, distance_m, speed_ms, n_alive (states with a finite end), n_next, n_paths at the boundary."""
        w = Window.partitionBy("trip_id").orderBy("seg")
        rows = self.segments().withColumns({"before_k": F.lag("k_last").over(w), "before_seg": F.lag("seg").over(w)}).where("before_k is not null")
        at = self.obs.where("not replayed").select("trip_id", "k", "lat", "lon", "t_first")
        a, b = (at.select("trip_id", F.col("k").alias(k), F.struct("lat", "lon", "t_first").alias(n)) for k, n in (("before_k", "a"), ("k_first", "b")))
        alive = self.inferred.where("alpha > double('-Infinity')").groupBy("trip_id", F.col("k").alias("before_k")).agg(F.count("*").alias("__alive"))
        ahead = self.states.groupBy("trip_id", F.col("k").alias("k_first")).agg(F.count("*").alias("n_next"))
        paths = self.paths.groupBy("trip_id", F.col("k").alias("before_k")).agg(F.count("*").alias("n_paths"))
        rows = rows.join(a, ["trip_id", "before_k"]).join(b, ["trip_id", "k_first"]).join(alive, ["trip_id", "before_k"], "left").join(ahead, ["trip_id", "k_first"], "left").join(paths, ["trip_id", "before_k"], "left")
        gap = F.col("b.t_first") - F.col("a.t_first")
        far = geo.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
        # Across a structural break only the most likely end counts as alive.
        n_alive = F.when(F.col("cliff"), F.coalesce("__alive", F.lit(0))).otherwise(F.lit(1))
        return rows.select("trip_id", "seg", F.col("before_k").alias("after_k"), gap.alias("gap_s"), far.alias("distance_m"), F.when(gap > 0, far / gap).otherwise(F.lit(float("inf"))).alias("speed_ms"), n_alive.cast("long").alias("n_alive"), F.coalesce("n_next", F.lit(0)).alias("n_next"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"))

    def least_route_times(self) -> DataFrame:
        """trip_id, seg, min_route_s: the least typical graph time from states before a boundary to states after it; infinite without a way."""
        bounds = self.discontinuities().select("trip_id", "seg", "after_k")
        first = self.inferred.groupBy("trip_id", "seg").agg(F.min("k").alias("k"))
        ends = self.edges.select("link_id", "from_node", "to_node")
        a = bounds.join(self.states.withColumnRenamed("k", "after_k"), ["trip_id", "after_k"]).join(ends, "link_id").select("trip_id", "seg", F.col("to_node").alias("from_node"))
        b = bounds.join(first, ["trip_id", "seg"]).join(self.states, ["trip_id", "k"]).join(ends, "link_id").select("trip_id", "seg", F.col("from_node").alias("to_node"))
        pairs = a.distinct().join(b.distinct(), ["trip_id", "seg"])
        times = routing.node_times(pairs, self.edges, "weight")
        return pairs.join(times, ["from_node", "to_node"]).groupBy("trip_id", "seg").agg(F.min("time_s").alias("min_route_s"))

    def at_observation(self, k: int) -> DataFrame:
        return self.state_marginals().where(F.col("k") == k)

    def at_time(self, times: DataFrame, rule: str = "front") -> DataFrame:
        """trip_id, t, link_id, offset_m, prob for query times (trip_id, t) within a segment; others have no rows.

        On an observation, or within its confirmed stay: its states. Between two: every path's
        place under the rule, weighed by the path's probability.
        """
        span = self.inferred.select("trip_id", "seg", "k").distinct()
        w = Window.partitionBy("trip_id", "seg").orderBy("k")
        grid = span.join(self.obs.where("not replayed").select("trip_id", "k", "t_first", "t_last"), ["trip_id", "k"]).withColumn("t_next", F.lead("t_first").over(w))
        hit = times.join(grid, "trip_id").where((F.col("t") == F.col("t_first")) | ((F.col("t") > F.col("t_first")) & (F.col("t") < F.col("t_next"))))
        # Of equal times the first observation counts.
        hit = hit.withColumn("__n", F.row_number().over(Window.partitionBy("trip_id", "t").orderBy((F.col("t") != F.col("t_first")).cast("int"), "k"))).where("__n = 1")
        end = F.when(F.col("t_next").isNotNull(), F.least("t_last", "t_next")).otherwise(F.col("t_last"))
        staying = (F.col("t") == F.col("t_first")) | (F.col("t") <= end)
        still = hit.where(staying).join(self.state_marginals(), ["trip_id", "seg", "k"]).select("trip_id", "t", "link_id", "offset_m", "prob")
        moving = hit.where(~staying).withColumn("tau", F.col("t") - end).select("trip_id", "t", "seg", "k", "tau")
        own = self.paths.drop("phi", "route")
        moving = moving.join(self.path_marginals(), ["trip_id", "seg", "k"]).join(own, ["trip_id", "k", "path_id"])
        placed = position_in_transition(moving.withColumn("__id", F.monotonically_increasing_id()), self.edges, rule)
        rows = still.unionByName(placed.select("trip_id", "t", "link_id", "offset_m", "prob"))
        return rows.groupBy("trip_id", "t", "link_id", "offset_m").agg(F.sum("prob").alias("prob"))

    def position_at_time(self, times: DataFrame, rule: str = "front") -> DataFrame:
        """trip_id, t, lat, lon: the most probable place at each time; times in gaps have no row."""
        best = self.at_time(times, rule).groupBy("trip_id", "t").agg(F.max_by(F.struct("link_id", "offset_m"), F.struct("prob", -F.col("link_id"))).alias("s"))
        return network.state_positions(best.select("trip_id", "t", "s.link_id", "s.offset_m"), self.edges)


def driven_fraction(tau: Column, budget: Column, ett: Column, rule: str) -> Column:
    """Share of a path driven tau seconds after the stay, under a dwell rule; 0 where there is no travel or budget."""
    if rule == "front":
        at = F.when(tau <= budget - ett, 0.0).otherwise((tau - (budget - ett)) / ett)
    elif rule == "back":
        at = F.when(tau >= ett, 1.0).otherwise(tau / ett)
    elif rule == "spread":
        at = tau / budget
    else:
        raise ValueError(f"unknown dwell rule {rule!r}")
    return F.when((ett <= 0) | (budget <= 0), 0.0).otherwise(F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0)))


def position_in_transition(rows: DataFrame, edges: DataFrame, rule: str) -> DataFrame:
    """rows (__id, tau, budget_s, ett_s, edges, mask, start_offset, end_offset, off_road) with link_id, offset_m. Off-road paths stand at an end."""
    rows = rows.withColumn("__frac", driven_fraction(F.col("tau"), F.col("budget_s"), F.col("ett_s"), rule))
    legs = rows.select("__id", "mask", "start_offset", "end_offset", F.size("edges").alias("n"), F.posexplode("edges").alias("i", "link_id")).join(edges.select("link_id", F.col("length_m").alias("len")), "link_id")
    rev = F.coalesce(F.get("mask", F.col("i")), F.lit(False))
    a = F.when(F.col("i") == 0, F.col("start_offset")).otherwise(F.when(rev, F.col("len")).otherwise(0.0))
    b = F.when(F.col("i") == F.col("n") - 1, F.col("end_offset")).otherwise(F.when(rev, 0.0).otherwise(F.col("len")))
    # Standing on one edge against its direction is no motion.
    size = F.when(rev, a - b).otherwise(b - a)
    legs = legs.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("i", "link_id", a.alias("a"), rev.alias("rev"), F.greatest(size, F.lit(0.0)).alias("m")))).alias("legs"))
    rows = rows.join(legs, "__id")
    whole = geo.total(F.transform("legs", lambda x: x["m"]))
    start = F.struct((F.col("__frac") * whole).alias("left"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("link_id"), F.lit(0.0).alias("offset_m"))

    def step(x: Column, leg: Column) -> Column:
        on = F.least(x["left"], leg["m"])
        here = F.struct((x["left"] - leg["m"]).alias("left"), (x["left"] <= leg["m"]).alias("done"), leg["link_id"].alias("link_id"), F.when(leg["rev"], leg["a"] - on).otherwise(leg["a"] + on).alias("offset_m"))
        return F.when(x["done"], x).otherwise(here)

    at = F.aggregate("legs", start, step)
    end = F.struct(F.element_at("edges", -1).alias("link_id"), F.col("end_offset").alias("offset_m"))
    begin = F.struct(F.col("edges")[0].alias("link_id"), F.col("start_offset").alias("offset_m"))
    spot = F.when(F.col("off_road"), F.when(F.col("__frac") < 0.5, begin).otherwise(end)).otherwise(F.struct(at["link_id"].alias("link_id"), at["offset_m"].alias("offset_m")))
    return rows.withColumn("__spot", spot).withColumns({"link_id": F.col("__spot.link_id"), "offset_m": F.col("__spot.offset_m")}).drop("legs", "__spot", "__frac")


def segment_islands(obs: DataFrame, states: DataFrame, paths: DataFrame) -> DataFrame:
    """trip_id, k, island: observations with states, numbered anew where states or paths to the next one are missing."""
    has = states.select("trip_id", "k").distinct()
    onward = paths.select("trip_id", (F.col("k") + 1).alias("k")).distinct().withColumn("__on", F.lit(1))
    rows = obs.select("trip_id", "k").join(has, ["trip_id", "k"]).join(onward, ["trip_id", "k"], "left")
    w = Window.partitionBy("trip_id").orderBy("k")
    new = F.coalesce(F.col("k") - F.lag("k").over(w) != 1, F.lit(True)) | F.col("__on").isNull()
    return rows.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w) - 1).select("trip_id", "k", "island")


def prepared(pings: DataFrame, edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Observations of trips: cleaned, without spikes, collapsed, with stale, replayed, dwell_s and budget_s. k is counted without replayed rows; these have k null."""
    rows = preprocess.clean(pings, cfg.hdop_max)
    rows = preprocess.drop_spikes(rows, cfg.spike_speed_ms, cfg.spike_bridge_speed_ms, cfg.spike_max_length)
    rows = kept(preprocess.collapse(rows, cfg.collapse_epsilon_m), "runs")
    w = Window.partitionBy("trip_id").orderBy("k")
    hops = rows.withColumns({"to_lat": F.lead("lat").over(w), "to_lon": F.lead("lon").over(w)}).where("to_lat is not null")
    travel = routing.shortest_times(hops.select("trip_id", "k", "lat", "lon", "to_lat", "to_lon"), edges, ["trip_id", "k"], cfg.max_speed_factor)
    rows = preprocess.mark_replay(preprocess.flag_stale(rows, travel), cfg.replay_max_speed_ms, cfg.max_speed_factor, cfg.replay_k_consistent, cfg.replay_moving_threshold_ms)
    rows = kept(rows, "marked")
    own = preprocess.budgets(preprocess.renumbered(rows.where("not replayed")))
    gone = rows.where("replayed").withColumns({"k": F.lit(None).cast("long"), "dwell_s": F.lit(0.0), "budget_s": F.lit(None).cast("double")})
    return own.unionByName(gone)


def reconstruct(pings: DataFrame, edges: DataFrame, cfg: Config = DEFAULT, keep=kept) -> Reconstruction:
    """All tables of a run. keep(df, name) writes a table and reads it again, so that each step is computed once."""
    if cfg.typical_speeds:
        edges = network.with_typical_speeds(edges, cfg.typical_speeds)
    obs = keep(prepared(pings, edges, cfg), "obs")
    own = obs.where("not replayed")
    states = keep(candidates.state_candidates(own, edges, cfg), "states")
    paths = keep(routing.candidate_paths(states, own.select("trip_id", "k", "budget_s"), edges, cfg), "paths")
    cells = keep(candidates.transition_cells(paths, states, cfg), "cells")
    scored = candidates.emissions(states, own, edges, cfg).select("trip_id", "k", F.col("rank").alias("i"), "log_e")
    inferred = keep(inference.infer(scored, candidates.cell_matrix(cells, ["trip_id", "k"])), "inferred")
    return Reconstruction(obs, states, paths, cells, inferred, edges)
