"""Registered queries over the driver tables, and their SQL twins for DuckDB.

Pings and the road lattice are derived by rule (sources.derived); real numbers are rounded to
six places, as the two engines may differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.config import Config
from pathloom.functions import geo
from pathloom.operators import analytics, candidates, inference, network, preprocess, routing, validation
from pathloom.plans import reconstruct
from pathloom.sources import derived, feeds
from pathloom.sources.work import kept

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def edges_of(spark: SparkSession) -> DataFrame:
    return network.build(derived.lattice_records(spark))


def hops(pings: DataFrame) -> DataFrame:
    """Pings with the next one of their trip."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    return pings.withColumns({"to_lat": F.lead("lat").over(w), "to_lon": F.lead("lon").over(w)}).where("to_lat is not null")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most likely state and route of every derived trip."""
    run = reconstruct.reconstruct(derived.pings(spark, sf_dir), kept(edges_of(spark)), keep=kept)
    return run.most_likely().select("trip_id", "seg", "k", "link_id", r6("offset_m").alias("offset_m"), F.array_join("edges", ",").alias("edges"), r6("ett_s").alias("ett_s"), "off_road")


# Sources and functions


def porto_explode(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda x: F.when(x["seq"] % 7 == 3, F.concat(F.lit("["), x["lon"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), x["lon"].cast("string"), F.lit(","), x["lat"].cast("string"), F.lit("]")))), ","), F.lit("]"))
    pings = derived.pings(spark, sf_dir)
    rows = (pings if whole else pings.where("seq < 12")).groupBy("trip_id").agg(text.alias("POLYLINE"))
    rows = rows.select(F.col("trip_id").cast("string").alias("TRIP_ID"), (F.lit(1704067200) + F.col("trip_id")).alias("TIMESTAMP"), F.when(F.col("trip_id") % 11 == 0, "True").otherwise("False").alias("MISSING_DATA"), F.when(F.col("trip_id") % 13 == 0, "[[1,").otherwise(F.col("POLYLINE")).alias("POLYLINE"))
    return feeds.exploded(rows).select("trip_id", "seq", F.col("t").cast("long").alias("t"), r6("lat").alias("lat"), r6("lon").alias("lon"))


def geo_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("lat", "lon", "to_lat", "to_lon")]
    return hops(preprocess.clean(derived.pings(spark, sf_dir))).select("trip_id", "seq", r6(geo.haversine_m(*c)).alias("haversine_m"), r6(geo.azimuth_deg(*c)).alias("azimuth_deg"), r6(geo.plane_m(*c)).alias("plane_m"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 12
    tag = F.when(k == 0, "50").when(k == 1, "30 mph").when(k == 2, " 80 km/h ").when(k == 3, "none").when(k == 4, "").when(k == 5, "0").when(k == 6, "60kmh").when(k == 7, "7.5 mph").when(k == 8, "50;30").when(k == 9, "100 kph").when(k == 10, "MPH 30")
    c = F.col("p_partkey") % 7
    road = F.when(c == 0, "motorway").when(c == 1, "motorway_link").when(c == 2, "primary").when(c == 3, "living_street").when(c == 4, "footway").when(c == 5, "service")
    o = F.col("p_partkey") % 9
    oneway = F.when(o == 0, "yes").when(o == 1, "-1").when(o == 2, "no").when(o == 3, "REVERSE").when(o == 4, "1").when(o == 5, "maybe").when(o == 6, "0")
    return part.select("p_partkey", tag.alias("tag"), road.alias("road_class"), oneway.alias("oneway"))


def maxspeed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tags(spark, sf_dir)
    return t.select("p_partkey", r6(geo.parsed_maxspeed(F.col("tag"), F.col("road_class"))).alias("max_ms"), geo.speed_cap(F.col("road_class")).alias("cap_ms"), geo.typical_speed(F.col("road_class")).alias("typ_ms"))


def oneway_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.directions(F.col("road_class"), F.col("oneway"))
    return _tags(spark, sf_dir).select("p_partkey", d["forward"].alias("forward"), d["backward"].alias("backward"))


# Preprocessing


def clean_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.clean(derived.pings(spark, sf_dir)).select("trip_id", "seq", F.col("t").cast("long").alias("t"), "lat", "lon")


def spike_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.drop_spikes(preprocess.clean(derived.pings(spark, sf_dir))).select("trip_id", "seq")


def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.collapse(preprocess.clean(derived.pings(spark, sf_dir)))
    return out.select("trip_id", "k", "lat", "lon", F.col("t_first").cast("long").alias("t_first"), F.col("t_last").cast("long").alias("t_last"), "n", "speed_max")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed runs of cleaned pings with a least travel time by rule, so that SQL can follow."""
    runs = kept(preprocess.collapse(preprocess.clean(derived.pings(spark, sf_dir))), "runs")
    w = Window.partitionBy("trip_id").orderBy("k")
    travel = geo.haversine_m(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)) / 11
    return preprocess.flag_stale(runs, runs.select("trip_id", "k", travel.alias("min_travel_s")))


def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("trip_id", "k", "stale")


def replay_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.mark_replay(_flagged(spark, sf_dir), max_speed_ms=10.0, moving_ms=20.0).select("trip_id", "k", "stale", "replayed")


def time_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.budgets(_flagged(spark, sf_dir)).select("trip_id", "k", r6("dwell_s").alias("dwell_s"), r6("budget_s").alias("budget_s"))


def thin_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.thin_by_stride(derived.pings(spark, sf_dir), 8).select("trip_id", "seq")


def thin_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.thin_by_time(preprocess.clean(derived.pings(spark, sf_dir)), 50.0).select("trip_id", "seq")


# The network


def network_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = spark.range(0, 441).select(F.when(F.col("id") % 5 == 0, "signal").when(F.col("id") % 7 == 0, "stop").alias("kind"), F.col("id").alias("node_id")).where("kind is not null")
    e = network.build(derived.lattice_records(spark), controls)
    return e.select("link_id", "road_class", "from_node", "to_node", r6("length_m").alias("length_m"), "max_ms", "typ_ms", "signal", "stop", "deg_from", "deg_to", r6("entry_deg").alias("entry_deg"), r6("exit_deg").alias("exit_deg"), "lo", "hi", "twin")


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = derived.lattice_records(spark)
    rows = network.node_degrees(rec).join(network.node_positions(rec), "node_id").join(network.adjacency(rec), "node_id", "left")
    return rows.select("node_id", "degree", r6("lat").alias("lat"), r6("lon").alias("lon"), F.array_join("links", ",").alias("links"))


def bbox_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.in_box(edges_of(spark), 41.141, 41.1495, -8.6195, -8.611, 300.0).select("link_id", "deg_from", "deg_to")


def project_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = network.project(preprocess.clean(derived.pings(spark, sf_dir)).select("trip_id", "seq", "lat", "lon"), edges_of(spark), ["trip_id", "seq"], 100.0, 4)
    return rows.select("trip_id", "seq", F.col("rank").cast("long").alias("rank"), "link_id", r6("offset_m").alias("offset_m"), r6("perp_m").alias("perp_m"))


def project_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = network.project_widening(preprocess.clean(derived.pings(spark, sf_dir)).select("trip_id", "seq", "lat", "lon"), edges_of(spark), ["trip_id", "seq"], 10.0, 3, 80.0)
    return rows.select("trip_id", "seq", F.col("rank").cast("long").alias("rank"), "link_id", r6("perp_m").alias("perp_m"))


def permissive_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.arcs(edges_of(spark), True).select("u", "v", "link_id", r6("weight").alias("weight"), r6("fastest").alias("fastest"), "illegal")


def shortest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole seconds by link keep sums exact in both engines.
    e = edges_of(spark).withColumn("length_m", F.ceil(F.col("length_m") / F.col("max_ms")) * F.col("max_ms"))
    pairs = spark.range(0, 441).select(F.lit(0).cast("long").alias("from_node"), F.col("id").alias("to_node"))
    return routing.node_times(pairs, e).select("from_node", "to_node", F.round("time_s").cast("long").alias("time_s"))


def _two_hop(spark: SparkSession) -> DataFrame:
    """Two-edge paths over the lattice with fields by rule."""
    e = derived.lattice_records(spark).select("link_id", "from_node", "to_node", "length_m", "road_class")
    b = e.select(*(F.col(c).alias(f"b_{c}") for c in e.columns))
    rows = e.join(b, F.col("to_node") == F.col("b_from_node")).where("b_to_node <> from_node")
    rows = rows.withColumn("path_id", F.col("link_id") * 10_000 + F.col("b_link_id"))
    key = F.col("path_id") % 3
    return rows.select(
        "path_id", F.array("link_id", "b_link_id").alias("edges"), F.when(key == 0, F.array(F.lit(True), F.lit(False))).when(key == 1, F.array(F.lit(True), F.lit(True))).alias("mask"), (F.col("path_id") % 5 == 4).alias("off_road"),
        (F.col("length_m") + F.col("b_length_m")).alias("length_m"), (F.col("path_id") % 97).cast("double").alias("ett_s"), F.lit(60.0).alias("budget_s"), (F.col("path_id") % 9).cast("double").alias("start_perp"), F.lit(2.0).alias("end_perp"),
    )


def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates.route_and_features(_two_hop(spark), edges_of(spark), ["path_id"])
    return rows.select("path_id", "route", *(r6(F.col("phi")[i]).alias(f"phi_{i:02d}") for i in range(19)))


def route_diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates.route_and_features(_two_hop(spark), edges_of(spark), ["path_id"]).withColumn("g", F.col("edges")[0] % 40)
    rows = rows.withColumn("r", F.when(network.diverse_rank(["g"], "route", ["ett_s", "path_id"]) == 1, 0).otherwise(1))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("r", "ett_s", "path_id"))).where("place <= 10").select("g", "path_id", F.col("place").cast("long").alias("place"))


def candidate_paths_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kept(edges_of(spark))
    obs = kept(preprocess.budgets(_flagged(spark, sf_dir)))
    states = kept(candidates.state_candidates(obs, edges))
    rows = routing.candidate_paths(states, obs.select("trip_id", "k", "budget_s"), edges, Config())
    return rows.select("trip_id", "k", "path_id", F.array_join("edges", ",").alias("edges"), F.array_join("mask", ",").alias("mask"), r6("ett_s").alias("ett_s"), r6("length_m").alias("length_m"), "off_road", "route")


# The derived trellis: six observations of three states, scores by rule in 64ths, so that sums are exact


def _trellis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    grid = lambda: spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("trip_id")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    states = grid().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("log_e", F.expr("-((trip_id * 31 + k * 17 + i * 7) % 100) / 64D"))
    cells = grid().where("k < 5").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("path_id", F.explode(F.expr("sequence(0L, 1L)")))
    cells = cells.where("(trip_id * 7 + k * 3 + i * 5 + j * 11 + path_id) % 6 <> 0").withColumn("log_p", F.expr("-((trip_id * 13 + k * 29 + i * 5 + j * 11 + path_id * 41) % 97) / 32D"))
    return states, cells.where("NOT (trip_id % 10 = 3 AND k = 2)")


def emission_logpdf(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    pings = preprocess.clean(derived.pings(spark, sf_dir))
    rows = network.near_edges((pings if whole else pings.where("seq < 10")).select("trip_id", "seq", "lat", "lon"), edges_of(spark), 60.0)
    return rows.select("trip_id", "seq", "link_id", r6(geo.log_student_t(F.col("perp_m"), 10.0, 4.0)).alias("log_e"), r6(geo.log_scale_gradient(F.col("perp_m"), 10.0, 4.0)).alias("slope"))


def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates.cell_matrix(_trellis(spark, sf_dir)[1], ["trip_id", "k"])
    return rows.select("trip_id", "k", "i", "j", r6("log_sum").alias("log_sum"), r6("log_max").alias("log_max"), "best_path")


def _inferred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    states, cells = _trellis(spark, sf_dir)
    return inference.infer(states, candidates.cell_matrix(cells, ["trip_id", "k"])), cells


def viterbi_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _inferred(spark, sf_dir)
    rows = rows.where("mle").groupBy("trip_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "i"))), lambda x: x["i"].cast("string")), ",").alias("states"), F.min("k").alias("k_first"))
    return rows.select("trip_id", F.col("seg").cast("long").alias("seg"), "k_first", "states")


def forward_backward(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    rows, _ = _inferred(spark, sf_dir)
    rows = rows if whole else rows.where("trip_id % 10 <> 3")
    return rows.select("trip_id", "k", "i", r6("prob").alias("prob"), r6("log_z").alias("log_z"))


def path_marginals(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    states, cells = _trellis(spark, sf_dir)
    cells = cells.withColumn("path_id", F.col("path_id") + 10 * F.col("i") + 100 * F.col("j"))
    rows = inference.path_marginals(kept(inference.infer(states, candidates.cell_matrix(cells, ["trip_id", "k"])), "inferred"), cells)
    rows = rows if whole else rows.where("trip_id % 10 <> 3")
    return rows.select("trip_id", "k", "path_id", r6("prob").alias("prob"))


def topk_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, cells = _trellis(spark, sf_dir)
    rows = inference.top_k(states, candidates.cell_matrix(cells, ["trip_id", "k"]), 6)
    return rows.select("trip_id", "place", r6("score").alias("score"))


def reconstruct_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def reconstruct_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = reconstruct.reconstruct(derived.pings(spark, sf_dir), kept(edges_of(spark)), keep=kept)
    times = run.obs.where("not replayed").select("trip_id", (F.col("t_first") + 7).alias("t"))
    return run.at_time(times, "spread").select("trip_id", F.col("t").cast("long").alias("t"), "link_id", r6("offset_m").alias("offset_m"), r6("prob").alias("prob"))


# Positions, validation and calibration over records by rule


def at_time(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = edges_of(spark).select("link_id", "from_node", "to_node", "length_m")
        b = e.select(F.col("link_id").alias("b_link"), F.col("from_node").alias("to_node"), F.col("to_node").alias("b_to"), F.col("length_m").alias("b_len"))
        rows = e.join(b, "to_node").where("b_to <> from_node").withColumn("__id", F.col("link_id") * 10_000 + F.col("b_link"))
        rows = rows.select("__id", F.array("link_id", "b_link").alias("edges"), F.lit(None).cast("array<boolean>").alias("mask"), (F.col("length_m") * 0.25).alias("start_offset"), (F.col("b_len") * 0.5).alias("end_offset"), (F.col("__id") % 60).cast("double").alias("tau"), F.lit(60.0).alias("budget_s"), (F.col("__id") % 41).cast("double").alias("ett_s"), F.lit(False).alias("off_road"))
        return reconstruct.position_in_transition(rows, edges_of(spark), rule).select(F.col("__id").alias("id"), "link_id", r6("offset_m").alias("offset_m"))

    return run


def snap_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.snap(preprocess.clean(derived.pings(spark, sf_dir)).select("trip_id", F.col("seq").alias("k"), "lat", "lon"), edges_of(spark))
    return rows.select("trip_id", "k", "link_id", r6("perp_m").alias("perp_m"))


def edge_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(validation.snap(preprocess.clean(derived.pings(spark, sf_dir)).select("trip_id", F.col("seq").alias("k"), "lat", "lon"), edges_of(spark)), "snapped")
    other = rows.select("trip_id", "k", F.when(F.col("k") % 9 == 0, F.lit(None)).when(F.col("k") % 4 == 0, F.col("link_id") + 2).otherwise(F.col("link_id")).alias("link_id"))
    return validation.disagreement(rows, other).select("trip_id", r6("rate").alias("rate"))


def _records(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """trip_id, k, path_id, prob, segs (edge keys), truth (edge keys): weighed candidate paths by rule."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = line if whole else line.where("l_orderkey % 8 = 0")
    rows = line.select((F.col("l_orderkey") / (1 if whole else 8)).cast("long").alias("trip_id"), (F.col("l_orderkey") % 5).alias("k"), F.col("l_linenumber").cast("long").alias("path_id"), F.col("l_partkey").alias("p"), (F.col("l_partkey") % 17 + 1).cast("double").alias("w"))
    # Dealt by transition at once, as all that follows is counted within one.
    rows = rows.repartition("trip_id", "k").groupBy("trip_id", "k", "path_id").agg(F.max("p").alias("p"), F.max("w").alias("w"))
    segs = F.array_distinct(F.array(*((F.col("p") % 4 + i * (1 + F.col("path_id") % 2)).cast("long") for i in range(6))))
    truth = F.array(*((F.col("trip_id") % 4 + i).cast("long") for i in range(6)))
    return rows.select("trip_id", "k", "path_id", (F.col("w") / F.sum("w").over(Window.partitionBy("trip_id", "k"))).alias("prob"), segs.alias("segs"), truth.alias("truth"))


def path_scores(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    rows = validation.path_scores(_records(spark, sf_dir, whole))
    return rows.select("trip_id", "k", r6("miss_rate").alias("miss_rate"), r6("best_jaccard").alias("best_jaccard"), "best_path", r6("entropy").alias("entropy"))


def topk_rank(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return validation.truth_rank(_records(spark, sf_dir, whole)).select("trip_id", "k", "truth_rank", "covered")


def edge_marginals(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return analytics.edge_marginals(_records(spark, sf_dir, whole)).select("trip_id", "k", "seg", r6("prob").alias("prob"), "on_truth")


def calibration_bins(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return analytics.reliability(analytics.edge_marginals(_records(spark, sf_dir, whole))).select("bin", "n", r6("stated").alias("stated"), r6("observed").alias("observed"))


def calibration_error(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return analytics.calibration_error(analytics.edge_marginals(_records(spark, sf_dir, whole))).select(r6("ece").alias("ece"))


def cluster_paths(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return analytics.clusters(_records(spark, sf_dir, whole), 0.4).select("trip_id", "k", "path_id", "cluster")


def diversity_filter(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return analytics.diverse(_records(spark, sf_dir, whole), 5, 0.5).select("trip_id", "k", "path_id", "place")


def overlap_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = preprocess.collapse(preprocess.clean(derived.pings(spark, sf_dir)))
    stays = runs.select("trip_id", F.col("t_first").alias("lo"), F.col("t_last").alias("hi"), (F.col("t_last") - F.col("t_first")).alias("dwell_s"))
    windows = runs.groupBy("trip_id").agg(F.min("t_first").alias("t0"), F.max("t_last").alias("t1")).withColumn("w", F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / 120).cast("int"))))
    windows = windows.select("trip_id", "w", (F.col("t0") + 120 * F.col("w")).alias("w_lo"), (F.col("t0") + 120 * (F.col("w") + 1)).alias("w_hi"))
    return analytics.overlap_sum(windows, stays).select("trip_id", F.col("w").cast("long").alias("w"), r6("dwell_s").alias("dwell_s"))


def nearest_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preprocess.clean(derived.pings(spark, sf_dir))
    truth = p.where("seq % 3 = 0").select("trip_id", "t", F.col("seq").alias("value"))
    return validation.nearest_in_time(p.where("seq % 3 <> 0").select("trip_id", "seq", "t"), truth, ["trip_id", "seq"]).select("trip_id", "seq", "value")


def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.pings(spark, sf_dir).where("lat <> 0").select("trip_id", *((F.pmod(F.col("seq") * x, F.lit(m)) + 1).cast("double").alias(n) for x, m, n in ((7, 13, "front"), (5, 11, "back"), (3, 17, "spread"))))
    rows = analytics.rule_errors(p, ["trip_id"], ["front", "back", "spread"])
    return rows.select("trip_id", "n", *(r6(f"{n}_median").alias(f"{n}_median") for n in ("front", "back", "spread", "oracle")), r6("oracle_p95").alias("oracle_p95"), "front_wins")


def sampling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hops(preprocess.clean(derived.pings(spark, sf_dir)))
    rows = h.withColumn("d", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")))
    return analytics.stats(rows, ["trip_id"], "d").select("trip_id", "n", *(r6(c).alias(c) for c in ("mean", "median", "p95", "max")))


def segment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = preprocess.clean(derived.pings(spark, sf_dir)).select("trip_id", F.col("seq").alias("k"))
    rows = reconstruct.segment_islands(obs, obs.where("k % 7 <> 5"), obs.where("k % 11 <> 9"))
    return rows.select("trip_id", "k", F.col("island").cast("long").alias("island"))


NAMES = [
    porto_explode, geo_functions, maxspeed_parse, oneway_resolve, clean_pings, spike_removal, collapse_runs, stale_runs, replay_bursts, time_budgets, thin_stride, thin_time,
    network_build, node_table, bbox_subgraph, project_topk, project_widening, permissive_arcs, shortest_time, path_features, route_diverse_topk, candidate_paths_full,
    emission_logpdf, cell_scores, viterbi_mle, forward_backward, path_marginals, topk_viterbi, reconstruct_mle, reconstruct_at_time, snap_baseline, edge_disagreement,
    path_scores, topk_rank, edge_marginals, calibration_bins, calibration_error, cluster_paths, diversity_filter, overlap_dwell, nearest_truth, rule_errors, sampling_stats, segment_islands,
]


#: Queries whose SQL twin holds a part of the input only; NAME_all runs over all of it.
PARTS = [forward_backward, path_marginals, path_scores, topk_rank, edge_marginals, calibration_bins, calibration_error, cluster_paths, diversity_filter, emission_logpdf, porto_explode]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES} | {f"{f.__name__}_all": partial(f, whole=True) for f in PARTS} | {f"at_time_{rule}": at_time(rule) for rule in ("front", "back", "spread")}


def oracle_sql() -> dict[str, str]:
    from pathloom import oracle

    return oracle.sql()
