"""Scenarios with known outcomes, and registered queries against their SQL twins."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import oracle, registry
from pathloom.config import Config, fitted_weights, generic_prior
from pathloom.functions import geo
from pathloom.operators import analytics, inference, network, preprocess, training, validation
from pathloom.plans import reconstruct
from pathloom.sources import derived, feeds

SF = "/root/testdata/sf0.001"
PINGS = "trip_id long, seq long, t double, lat double, lon double, hdop double, reported_speed double"
ORACLES = ["porto_explode", "geo_functions", "maxspeed_parse", "oneway_resolve", "clean_pings", "spike_removal", "collapse_runs", "replay_bursts", "thin_time", "bbox_subgraph", "permissive_arcs", "cell_scores", "viterbi_mle", "forward_backward", "topk_viterbi", "path_scores", "topk_rank", "edge_marginals", "calibration_bins", "cluster_paths", "diversity_filter", "overlap_dwell", "nearest_truth", "segment_islands", "at_time_front"]


def pings(spark, rows):
    return spark.createDataFrame([(1, i, float(t), float(a), float(b), h, s) for i, (t, a, b, h, s) in enumerate(rows)], PINGS)


def test_clean_keeps_later_valid_pings(spark):
    p = (19.43, -99.13)
    rows = [(0, *p, None, None), (1, 0, 0, None, None), (2, *p, 20.0, None), (3, 200, 0, None, None), (4, *p, 1.0, None), (4, *p, None, None), (3, *p, None, None), (5, *p, None, None)]
    assert [r.t for r in preprocess.clean(pings(spark, rows)).orderBy("seq").collect()] == [0, 4, 5]


def test_collapse_counts(spark):
    rows = [(i, 19.43 + i * 1e-6, -99.13, None, 1.0 if i == 2 else None) for i in range(5)] + [(5, 19.4303, -99.13, None, None), (6, 19.4303, -99.13, None, None)]
    got = preprocess.collapse(pings(spark, rows)).orderBy("k").collect()
    assert [r.n for r in got] == [5, 2] and got[0].t_last - got[0].t_first == 4 and got[0].speed_max == 1.0


def test_spike_of_limited_length():
    t = np.arange(9) * 15.0
    lat = np.array([41.0] * 2 + [41.5] * 5 + [41.0] * 2)
    lon = np.full(9, -8.6)
    assert not preprocess.spike_rows(t, lat, lon, 150, 100, 3).any()
    assert preprocess.spike_rows(t, lat, lon, 150, 100, 5).tolist() == [False] * 2 + [True] * 5 + [False] * 2


def test_replay_chain_length(spark):
    rows = [(1, k, 19.43 + k * 0.0001, -99.13, 10.0 * k, 10.0 * k, n, s, st) for k, (n, s, st) in enumerate([(1, None, True), (3, 5.0, False), (1, None, False), (3, 5.0, False), (1, None, False), (1, None, False)])]
    df = spark.createDataFrame(rows, "trip_id long, k long, lat double, lon double, t_first double, t_last double, n long, speed_max double, stale boolean")
    flags = lambda k: [r.replayed for r in preprocess.mark_replay(df, k=k).orderBy("k").collect()]
    assert flags(1) == [False, True, False, False, False, False]
    assert flags(2) == [False, True, True, True, False, False]


def test_violation_runs(spark):
    got = spark.createDataFrame([([True, True],), ([True, False, True],), ([],), (None,)], "m array<boolean>").select(geo.true_runs(F.col("m")).alias("n")).collect()
    assert [r.n for r in got] == [1, 2, 0, 0]


def test_polyline_geometry_of_bent_edges(spark):
    coords = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))))
    r = spark.range(1).select(geo.point_at(coords, F.lit(200.0), F.lit(150.0)).alias("p"), geo.projected(coords, F.lit(200.0), F.lit(0.5), F.lit(1.1)).alias("q"), geo.line_degrees(coords).alias("d")).first()
    assert (r.p.lon, r.p.lat, r.d) == (1.0, 0.5, 2.0) and abs(r.q.offset_m - 150) < 1e-9


def test_forward_backward_closed_forms():
    alpha, beta, z = inference.forward_backward([np.array([-1.0, -1.0]), np.array([0.0])], [np.array([[-1.5], [-3.5]])])
    assert math.isclose(z, math.log(math.exp(-2.5) + math.exp(-4.5)))
    assert math.isclose(math.exp(alpha[0][0] + beta[0][0] - alpha[0][1] - beta[0][1]), math.exp(2))
    assert math.isclose(inference.forward_backward([np.array([0.0, -1.0])], [])[2], math.log(1 + math.exp(-1)))
    assert inference.best_sequences([np.array([0.0]), np.array([0.0])], [None]) == [(0, [0]), (1, [0])]


def test_weights():
    assert fitted_weights(None) == (0.0,) * 19 and fitted_weights([1.0] * 18)[18] == -2.0 and generic_prior()[0] == -2.0
    with pytest.raises(ValueError):
        fitted_weights([1.0] * 5)
    with pytest.raises(ValueError):
        Config(emission_scale=0)
    with pytest.raises(ValueError):
        reconstruct.driven_fraction(None, None, None, "middle")


def test_ways_are_cut_at_shared_nodes(spark):
    nodes = spark.createDataFrame([(i, 41.0 + i * 0.001, -8.6) for i in range(6)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(7, "primary", None, None, [0, 1, 2]), (8, "service", "yes", "30", [1, 5])], "way_id long, road_class string, oneway string, maxspeed string, nodes array<long>")
    got = {(r.from_node, r.to_node): r.link_id for r in feeds.way_edges(ways, nodes).collect()}
    assert set(got) == {(0, 1), (1, 0), (1, 2), (2, 1), (1, 5)} and got[0, 1] == 7 and got[1, 5] == 8 and sorted(got.values())[2:] == [10**12 + i for i in range(3)]


def test_sources_round_trip(spark, tmp_path):
    feeds.write_weights(spark, list(range(19)), f"{tmp_path}/w")
    assert feeds.read_weights(spark, f"{tmp_path}/w") == tuple(map(float, range(19))) and feeds.read_weights(spark, f"{tmp_path}/none") == (0.0,) * 19
    feeds.write_labels(spark.range(3).toDF("id"), f"{tmp_path}/l", {"prior": "none"})
    assert feeds.read_labels(spark, f"{tmp_path}/l").count() == 3
    feeds.write_records(spark.range(3).toDF("id"), f"{tmp_path}/r", "undirected")
    with pytest.raises(ValueError):
        feeds.read_records(spark, f"{tmp_path}/r", "directed")


def test_isotonic_is_monotone(spark):
    rows = spark.createDataFrame([(i / 100, i % 3 == 0 or i > 70) for i in range(100)], "prob double, on_truth boolean")
    got = [r.rescaled for r in analytics.isotonic(rows).orderBy("prob").collect()]
    assert got == sorted(got)


def test_hold_out_keeps_the_ends(spark):
    kept, masked = validation.hold_out(derived.pings(spark, SF), 0.25)
    assert masked.count() > 0 and kept.where("seq = 0").count() == kept.select("trip_id").distinct().count()


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    # Nullable integers come as floats from one side.
    value = lambda v: v if isinstance(v, (str, bool)) else None if v is None or v != v else float(v)
    plain = lambda df: sorted(repr([value(v) for v in row]) for row in df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist())
    assert plain(registry.queries()[name](spark, SF).toPandas()) == plain(c.execute(oracle.sql()[name]).df())


def test_reconstruction(spark):
    edges = network.build(derived.lattice_records(spark))
    run = reconstruct.reconstruct(derived.pings(spark, SF).where("trip_id < 4 and seq < 30"), registry.kept(edges))
    sums = run.path_marginals().groupBy("trip_id", "seg", "k").agg(F.sum("prob").alias("p")).collect()
    assert sums and all(abs(r.p - 1) < 1e-9 for r in sums)
    best = run.most_likely()
    assert best.count() == best.select("trip_id", "k").distinct().count() > 0
    times = run.obs.where("not replayed").select("trip_id", (F.col("t_first") + 7).alias("t"))
    assert all(abs(r.p - 1) < 1e-9 for r in run.at_time(times, "back").groupBy("trip_id", "t").agg(F.sum("prob").alias("p")).collect())


def test_gradient_and_optimiser():
    import pandas as pd

    rng = np.random.default_rng(0)
    states = pd.DataFrame([(1, k, i, rng.uniform(1, 30), i == 0) for k in range(3) for i in range(2)], columns=["trip_id", "k", "i", "distance_m", "label"])
    cells = pd.DataFrame([(1, k, i, j, 2 * i + j, rng.normal(size=19), i == j == 0) for k in range(2) for i in range(2) for j in range(2)], columns=["trip_id", "k", "i", "j", "path_id", "phi", "label"])
    x = np.append(rng.normal(size=19) * 0.1, np.log(8.0))
    f = lambda v: training.trip_gradient(states, cells, v[:-1], float(np.exp(v[-1])), 4.0)
    g = f(x)[1]
    for i in range(20):
        e = np.eye(20)[i] * 1e-5
        assert abs((f(x + e)[0] - f(x - e)[0]) / 2e-5 - g[i]) < 1e-6
    best, ok = training.minimise(lambda v: (float(((v - 3) ** 2).sum()), 2 * (v - 3)), np.zeros(4), np.full(4, -np.inf), np.array([np.inf, np.inf, 1.0, np.inf]), 50)
    assert ok and np.allclose(best, [3, 3, 1, 3], atol=1e-4)
