"""Queries that must hold on large tables: what their plans may not do, and results against plain versions."""

import math
import re

import pytest
from pyspark.sql import functions as F

from pathloom import registry
from pathloom.operators import network
from tests.test_whole import SF, by_sql, plain

#: Queries that look for edges near pings.
NEAR = ["edge_disagreement", "project_widening", "snap_baseline", "emission_logpdf_all", "project_topk"]


def unsigned(rows):
    # DuckDB keeps the sign of a zero offset that Spark's round() drops.
    return sorted(re.sub(r"-0\.0(?=[,\]])", "0.0", r) for r in rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NEAR)
def test_points_meet_edges_without_a_shuffle_by_cell(spark, monkeypatch, name):
    met = []
    own = network._met
    monkeypatch.setattr(network, "_met", lambda *a: met.append(own(*a)) or met[-1])
    assert unsigned(plain(registry.queries()[name](spark, SF).toPandas())) == unsigned(plain(by_sql(name)))
    assert len(met) == 1
    assert "BroadcastHashJoin" in plan(met[0]) and "hashpartitioning(cy" not in plan(met[0]) and "SortMergeJoin" not in plan(met[0])


def nearest(p, coords, length):
    """Distance and offset of the place on a polyline that is nearest in degrees."""
    best, pos, sizes = (math.inf, 0.0, 0.0, 0.0), 0.0, []
    for (ax, ay), (bx, by) in zip(coords, coords[1:]):
        dx, dy = bx - ax, by - ay
        s2 = dx * dx + dy * dy
        t = min(max(((p[1] - ax) * dx + (p[0] - ay) * dy) / s2, 0.0), 1.0) if s2 else 0.0
        x, y = ax + t * dx, ay + t * dy
        d2 = (p[1] - x) ** 2 + (p[0] - y) ** 2
        if d2 < best[0]:
            best = (d2, pos + t * math.sqrt(s2), y, x)
        pos += math.sqrt(s2)
    if not pos:
        return math.inf, 0.0
    return math.hypot((best[2] - p[0]) * 111_320, (best[3] - p[1]) * 111_320 * math.cos(math.radians(p[0]))), best[1] / pos * length


def test_near_edges_of_legs_and_polylines(spark, monkeypatch):
    """Single legs, polylines, and edges of one place or one point, broadcast or not."""
    lines = {1: [(0.0, 60.0), (0.002, 60.0)], 2: [(0.0, 60.001), (0.001, 60.0012), (0.001, 60.003)], 3: [(0.001, 60.0005)] * 2, 4: [(0.001, 60.0005)], 5: [(0.002, 60.0), (0.0, 60.0)], 6: [(-0.003, 59.999), (0.009, 60.004)]}
    rows = [(n, [{"lon": x, "lat": y} for x, y in c], 100.0 * n, min(y for _, y in c), max(y for _, y in c), min(x for x, _ in c), max(x for x, _ in c)) for n, c in lines.items()]
    edges = spark.createDataFrame(rows, "link_id long, coords array<struct<lon double, lat double>>, length_m double, lat_min double, lat_max double, lon_min double, lon_max double")
    points = [(i * 20 + j, 59.998 + i * 0.0004, -0.004 + j * 0.0007) for i in range(20) for j in range(20)]
    at = spark.createDataFrame(points, "n long, lat double, lon double")
    want = {(n, e): nearest((lat, lon), c, 100.0 * e) for n, lat, lon in points for e, c in lines.items()}
    want = {k: v for k, v in want.items() if v[0] <= 90.0}
    first = {n: min(((d, e) for (m, e), (d, _) in want.items() if m == n), default=(None, None))[1] for n, _, _ in points}
    for most in (network.BROADCAST_CELLS, 0):
        monkeypatch.setattr(network, "BROADCAST_CELLS", most)
        got = {(r.n, r.link_id): (r.perp_m, r.offset_m) for r in network.near_edges(at, edges, 90.0).collect()}
        assert got.keys() == want.keys() and {2, 6} <= {e for _, e in got}
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
        one = {r.n: r.link_id for r in network.nearest_edge(at, edges, ["n"], 90.0).collect()}
        assert one.keys() == first.keys() and None in one.values()
        # Links 1 and 5 are one road in two directions.
        assert all({one[n], e} <= {1, 5} or one[n] == e for n, e in first.items())


@pytest.mark.parametrize("name", ["path_marginals_all", "path_marginals"])
def test_marginals_neither_broadcast_nor_infer_again(spark, name):
    got = registry.queries()[name](spark, SF)
    assert plain(got.toPandas()) == plain(by_sql(name))
    final = plan(got)
    assert "isFinalPlan=true" in final and "SortMergeJoin" in final
    assert "Broadcast" not in final.split("== Initial Plan ==")[0] and "FlatMapCoGroups" not in final


def jaccard(a, b):
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def paths(spark):
    """Transitions of 1 to 60 paths with sets of 0 to 7 edges, some repeated within an array, some arrays null, in more batches than one."""
    import random

    draw = random.Random(7)
    rows = []
    for trip in range(400):
        for k in range(3):
            for p in range(60 if trip % 97 == 0 else draw.randint(1, 6)):
                rows.append((trip, k, p * 3 % 61, draw.randint(1, 9) / 10, draw.choices(range(5 + p), k=draw.randint(0, 7)) if draw.random() < 0.95 else None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    yield rows, spark.createDataFrame(rows, "trip_id long, k long, path_id long, prob double, segs array<long>").repartition(5)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def transitions(rows):
    out = {}
    for trip, k, p, prob, segs in rows:
        out.setdefault((trip, k), {})[p] = (prob, set(segs or ()))
    return out


@pytest.mark.parametrize("tau", [0.0, 0.4, 0.8])
def test_clusters_of_many_transitions_at_once(paths, tau):
    rows, table = paths
    got = registry.analytics.clusters(table, tau)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = {}
    for at, own in transitions(rows).items():
        for p in own:
            seen, open_ = {p}, [p]
            while open_:
                x = open_.pop()
                new = {y for y in own if y not in seen and jaccard(own[x][1], own[y][1]) <= tau}
                seen |= new
                open_ += new
            want[*at, p] = min(seen)
    assert {(r.trip_id, r.k, r.path_id): r.cluster for r in got.collect()} == want


@pytest.mark.parametrize("tau", [0.3, 0.5, 1.0])
def test_diverse_paths_of_many_transitions_at_once(paths, tau):
    rows, table = paths
    got = registry.analytics.diverse(table, 5, tau)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = {}
    for at, own in transitions(rows).items():
        taken = []
        for p in sorted(own, key=lambda p: (-own[p][0], p)):
            # Two empty sets are wholly different here.
            if len(taken) < 5 and all(1 - len(own[p][1] & own[t][1]) / max(1, len(own[p][1] | own[t][1])) >= tau for t in taken):
                taken.append(p)
                want[*at, p] = len(taken)
    assert {(r.trip_id, r.k, r.path_id): r.place for r in got.collect()} == want


def test_paths_of_one_shape_share_features(spark, monkeypatch):
    """3 x 60 paths of few shapes: road edges are read once a shape, and each path has its own lengths and times."""
    from pathloom.operators import candidates

    seen, own = {}, candidates.kept
    monkeypatch.setattr(candidates, "kept", lambda df, name: seen.setdefault(name, own(df, name)))
    edges = registry.kept(registry.edges_of(spark))
    one = registry._two_hop(spark).orderBy("path_id").limit(60)
    unknown = one.limit(1).withColumn("edges", F.expr("array(-1L, -2L)")).withColumn("path_id", F.lit(-1).cast("long"))
    many = registry.kept(one.unionByName(unknown).withColumn("copy", F.explode(F.expr("array(0, 1, 2)"))).withColumn("length_m", F.col("length_m") + F.col("copy")))
    got = {(r.path_id, r.copy): r for r in candidates.route_and_features(many, edges, ["path_id", "copy"]).collect()}
    assert len(got) == 183 and seen["shapes"].count() == many.select("edges", "mask", "off_road").distinct().count() <= 61
    want = {r.path_id: r for r in registry.path_features(spark, SF).collect()}
    for (path, copy), r in got.items():
        if path >= 0:
            assert r.route == want[path].route
            assert [round(x, 6) for x in r.phi[1:]] == pytest.approx([want[path][f"phi_{i:02d}"] for i in range(1, 19)], abs=2e-6)
            assert r.phi[0] == pytest.approx(r.length_m / 1000) == pytest.approx(want[path].phi_00 + copy / 1000, abs=1e-6)
        else:
            assert r.route == ("" if not r.off_road else None) and r.phi[1] == 0


def test_both_ends_of_hops_are_found_in_one_pass(spark, monkeypatch):
    seen, own = [], network.nearest_edge
    monkeypatch.setattr(network, "nearest_edge", lambda *a: seen.append(a) or own(*a))
    edges = registry.kept(registry.edges_of(spark))
    e = {r.link_id: r for r in edges.collect()}
    points = spark.createDataFrame([(1, 0, 41.13, -8.6298, 41.13, -8.6285), (1, 1, 41.13, -8.6298, 45.0, 0.0), (1, 2, 45.0, 0.0, 45.0, 0.0)], "trip_id long, k long, lat double, lon double, to_lat double, to_lon double")
    got = {r.k: r.min_travel_s for r in registry.routing.shortest_times(points, edges, ["trip_id", "k"], 2.0).collect()}
    assert len(seen) == 1
    link = e[min(n for n, r in e.items() if {r.from_node, r.to_node} == {0, 1})]
    assert got == {0: pytest.approx(link.length_m * 0.65 / link.max_ms / 2, rel=1e-6), 1: math.inf, 2: math.inf}


def test_runs_without_groups_of_a_trip(spark):
    """Collapsed runs by arrays: first, last, size and the largest known speed."""
    rows = [(t, n, 10.0 * n, 41.0 + (n // 3 + t) * 0.001, -8.0, None if (n + t) % 4 else float(n)) for t in (1, 2) for n in range(10)]
    table = spark.createDataFrame(rows, "trip_id long, seq long, t double, lat double, lon double, reported_speed double")
    want = set()
    for t in (1, 2):
        for k in range(4):
            own = [r for r in rows if r[0] == t and r[1] // 3 == k]
            speeds = [r[5] for r in own if r[5] is not None]
            want.add((t, k, own[0][3], -8.0, own[0][2], own[-1][2], len(own), max(speeds) if speeds else None))
    assert {tuple(r) for r in registry.preprocess.collapse(table).collect()} == want
    # The function that Spark ships does not group by run.
    names = registry.preprocess.collapse.__code__.co_consts
    assert not any("groupby" in c.co_names for c in names if hasattr(c, "co_names"))


def test_inference_of_many_trips_at_once(spark):
    """Trips with breaks, gaps in k, lone states and cells without states, in more batches than one: no group of a trip, and sums over all ways as by hand."""
    import itertools
    import random

    from pathloom.operators import inference

    draw = random.Random(11)
    states, cells = [], []
    for trip in range(60):
        for k in range(draw.randint(1, 5)):
            if trip % 7 != 3 or k != 1:
                states += [(trip, k + trip % 3, i, -draw.random()) for i in range(draw.randint(1, 3))]
        size = {k: sum(1 for s in states if s[:2] == (trip, k)) for k in range(9)}
        for k, i, j in itertools.product(range(8), range(3), range(3)):
            if i < size[k] and j < size[k + 1] and not (trip % 5 == 2 and k == 2) and draw.random() < 0.9:
                x = -draw.random()
                cells.append((trip, k, i, j, x + 0.1, x, 100 * k + 10 * i + j))
    cells.append((99, 0, 0, 0, 0.0, 0.0, 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = inference.infer(spark.createDataFrame(states, "trip_id long, k long, i int, log_e double").repartition(3), spark.createDataFrame(cells, "trip_id long, k long, i int, j int, log_sum double, log_max double, best_path long").repartition(3))
        assert "FlatMapCoGroups" not in plan(got)
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.trip_id for r in rows} == set(range(60)) and {r.seg for r in rows} > {0, 1} and any(r.cliff for r in rows) is False
    e, sums, tops = {s[:3]: s[3] for s in states}, {c[:4]: c[4] for c in cells}, {c[:4]: c[5:] for c in cells}
    segments = {}
    for r in rows:
        segments.setdefault((r.trip_id, r.seg), {}).setdefault(r.k, {})[r.i] = r
    # A segment's states are all of its observations'.
    assert all(len(own) == sum(1 for s in e if s[:2] == (trip, k)) for (trip, _), ks in segments.items() for k, own in ks.items())
    for (trip, _), ks in segments.items():
        first, last = min(ks), max(ks)
        assert sorted(ks) == list(range(first, last + 1))
        ways = {}
        for way in itertools.product(*(sorted(ks[k]) for k in range(first, last + 1))):
            steps = [(trip, first + n, a, b) for n, (a, b) in enumerate(zip(way, way[1:]))]
            if all(x in sums for x in steps):
                at = sum(e[trip, first + n, i] for n, i in enumerate(way))
                ways[way] = (at + sum(sums[x] for x in steps), at + sum(tops[x][0] for x in steps))
        z = sum(math.exp(x) for x, _ in ways.values())
        best = max(ways, key=lambda w: ways[w][1])
        for k, own in ks.items():
            for i, r in own.items():
                assert r.log_e == e[trip, k, i] and r.log_z == pytest.approx(math.log(z))
                assert r.prob == pytest.approx(sum(math.exp(x) for w, (x, _) in ways.items() if w[k - first] == i) / z, abs=1e-12)
                assert r.mle == (best[k - first] == i)
                assert r.mle_path == (tops[trip, k, i, best[k + 1 - first]][1] if r.mle and k < last else None)


def test_cells_follow_the_radius(spark, monkeypatch):
    """Small cells while they are few enough: a cell then holds few edges, and for the nearest edge only those that can be it."""
    edges = registry.kept(registry.edges_of(spark))
    held = {}
    for most in (network.BROADCAST_CELLS, 2_000, 0):
        monkeypatch.setattr(network, "BROADCAST_CELLS", most)
        for radius, nearest in ((60.0, False), (200.0, False), (200.0, True)):
            cells, side = network._shared_cells(edges, radius, nearest)
            held[most, radius, nearest] = side, cells.groupBy("cy", "cx").count().agg(F.avg("count")).first()[0], "ResolvedHint" in cells._jdf.queryExecution().analyzed().toString()
    assert held[200_000, 60.0, False][0] == held[200_000, 200.0, True][0] == network.CELL / 8 and held[0, 60.0, False][0] == network.CELL
    assert all(known == (most > 0) for (most, _, nearest), (_, _, known) in held.items() if not nearest and most != 2_000)
    assert held[200_000, 60.0, False][1] < held[0, 60.0, False][1] / 3 and held[200_000, 200.0, True][1] < held[200_000, 200.0, False][1] / 2


@pytest.mark.parametrize("name", ["project_widening", "emission_logpdf_all"])
def test_distances_are_not_tested_within_the_join(spark, name):
    join = next(x for x in plan(registry.queries()[name](spark, SF)).splitlines() if "BroadcastHashJoin" in x)
    assert "aggregate(" not in join


def test_points_are_ranked_after_the_ring_is_known(spark):
    lines = [x for x in plan(registry.project_widening(spark, SF)).splitlines() if re.search(r"[-+] (Sort|Window|BroadcastHashJoin) ?", x)]
    at = next(n for n, x in enumerate(lines) if "min(perp_m" in x)
    # Least distance by window right on the join, then a sort of what is left.
    assert "BroadcastHashJoin" in lines[at + 1] and "Sort [" in lines[at - 1] and "perp_m" in lines[at - 1]


def test_nearest_edges_with_few_and_with_all_cells(spark, monkeypatch):
    """Long, short, crossing, equal and pointlike edges, far north: the same links with and without what cannot be the nearest."""
    import random

    draw = random.Random(5)
    rows = []
    for n in range(150):
        lat, lon = 64.0 + draw.random() * 0.02, 20.0 + draw.random() * 0.04
        far = draw.choice([0.0, 0.0003, 0.003, 0.02])
        line = [(lon, lat)] + [(lon + draw.uniform(-far, far), lat + draw.uniform(-far, far)) for _ in range(draw.choice([1, 1, 1, 2, 4]))]
        rows += [(2 * n + twin, [{"lon": x, "lat": y} for x, y in line], 10.0, min(y for _, y in line), max(y for _, y in line), min(x for x, _ in line), max(x for x, _ in line)) for twin in range(1 + n % 2)]
    edges = spark.createDataFrame(rows, "link_id long, coords array<struct<lon double, lat double>>, length_m double, lat_min double, lat_max double, lon_min double, lon_max double")
    points = spark.createDataFrame([(n, 63.998 + draw.random() * 0.024, 19.996 + draw.random() * 0.048) for n in range(3000)], "n long, lat double, lon double")
    cut = {r.n: tuple(r) for r in network.nearest_edge(points, edges, ["n"], 150.0).collect()}
    monkeypatch.setattr(network, "could_be_nearest", lambda cells, side: cells)
    assert {r.n: tuple(r) for r in network.nearest_edge(points, edges, ["n"], 150.0).collect()} == cut
    assert sum(x[1] is None for x in cut.values()) > 10 and len({x[1] for x in cut.values()}) > 50


@pytest.mark.parametrize("name", ["diversity_filter_all", "cluster_paths_all"])
def test_records_are_shuffled_once(spark, name):
    got = registry.queries()[name](spark, SF)
    assert plain(got.toPandas()) == plain(by_sql(name))
    start = plan(registry.queries()[name](spark, SF))
    assert start.count("Exchange hashpartitioning(") == 1


def test_trips_are_cleaned_many_at_once(spark):
    """Spikes and runs of trips that lie in more batches than one, without a group of a trip; a run does not go on in the next trip."""
    from pathloom.operators import preprocess

    # A ping far off at 3, and two at one place at 5 and 6; all trips begin and end at one place.
    at = [0.0, 0.001, 0.002, 0.09, 0.003, 0.002, 0.002, 0.0]
    rows = [(t, n, 20.0 * n, 41.0 + x, -8.0, None if n % 2 else float(t)) for t in range(40) for n, x in enumerate(at[: 1 if t % 9 == 4 else 8])]
    table = spark.createDataFrame(rows, "trip_id long, seq long, t double, lat double, lon double, reported_speed double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        whole = preprocess.drop_spikes(table, 50.0, 50.0, 3)
        runs = preprocess.collapse(table, 10.0)
        assert not any("FlatMapGroupsInPandas" in plan(x) for x in (whole, runs))
        assert {(r.trip_id, r.seq) for r in whole.collect()} == {r[:2] for r in rows if r[1] != 3}
        got = {(r.trip_id, r.k): (r.t_first, r.t_last, r.n, r.speed_max) for r in runs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for t in range(40):
        for k, (a, b) in enumerate([(0, 0)] if t % 9 == 4 else [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 6), (7, 7)]):
            speeds = [float(t) for n in range(a, b + 1) if n % 2 == 0]
            want[t, k] = (20.0 * a, 20.0 * b, b - a + 1, max(speeds, default=None))
    assert got == want
