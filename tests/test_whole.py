"""Queries over all of their input, not a part of it."""

import collections
import itertools
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pathloom import oracle, registry
from pathloom.operators import network
from pathloom.plans import reconstruct
from pathloom.sources import derived

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """A folder with nine events of each of three trips, two of them past the first thirty."""
    d = str(tmp_path_factory.mktemp("few"))
    rows = [(100 * u + i, u, 1000 * u + i, 10.0) for u in (5, 33, 1007) for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, n long, value double")
    events.select("event_id", F.timestamp_seconds("n").alias("ts"), "user_id", "value").write.parquet(f"{d}/events.parquet")
    return d


def by_sql(name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c.execute(oracle.sql()[name]).df()


def plain(df):
    # Nullable integers come as floats from one side.
    value = lambda v: v if isinstance(v, (str, bool)) else None if v is None or v != v else float(v)
    return sorted(repr([value(v) for v in row]) for row in df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", ["forward_backward_all", "path_marginals_all"])
def test_broken_trips_against_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert {3, 13} <= set(got["trip_id"])
    assert plain(got) == plain(by_sql(name))


def walked(path, lengths, frac):
    """Link and offset at a share of a path on the road."""
    legs = []
    for n, link in enumerate(path.edges):
        rev = bool(path.mask and path.mask[n])
        a = path.start_offset if n == 0 else lengths[link] * rev
        b = path.end_offset if n == len(path.edges) - 1 else lengths[link] * (not rev)
        legs.append((link, a, rev, max(0.0, a - b if rev else b - a)))
    left = frac * sum(x[3] for x in legs)
    for link, a, rev, m in legs:
        if left <= m:
            break
        left -= m
    return link, a + min(left, m) * (-1 if rev else 1)


def test_at_time_of_all_trips_by_enumeration(spark, few):
    """Every state sequence of each segment is weighed, and every path placed."""
    edges = network.build(derived.lattice_records(spark))
    run = reconstruct.reconstruct(derived.pings(spark, few), registry.kept(edges))
    lengths = {r.link_id: r.length_m for r in edges.collect()}
    log_e, offsets, cells, segs = {}, {}, collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(set)
    for r in run.inferred.collect():
        log_e[r.trip_id, r.k, r.i] = r.log_e
        segs[r.trip_id, r.seg].add(r.k)
    for r in run.states.collect():
        offsets[r.trip_id, r.k, r["rank"]] = (r.link_id, r.offset_m)
    for r in run.cells.collect():
        cells[r.trip_id, r.k][r.i, r.j].append((r.path_id, math.exp(r.log_p)))
    paths = {(r.trip_id, r.k, r.path_id): r for r in run.paths.collect()}
    obs = {(r.trip_id, r.k): r for r in run.obs.where("not replayed").collect()}
    at = lambda trip, k: [i for t, n, i in log_e if (t, n) == (trip, k)]
    want = collections.defaultdict(lambda: [0.0, 0.0])
    for (trip, _), ks in segs.items():
        ks = sorted(ks)
        weights = collections.Counter()
        for states in itertools.product(*(at(trip, k) for k in ks)):
            w = math.exp(sum(log_e[trip, k, i] for k, i in zip(ks, states)))
            for k, i, j in zip(ks, states, states[1:]):
                w *= sum(p for _, p in cells[trip, k].get((i, j), []))
            if w:
                weights[states] = w
        z = sum(weights.values())
        for n, k in enumerate(ks):
            o, later = obs[trip, k], obs[trip, ks[n + 1]] if n + 1 < len(ks) else None
            for t in {int(x.t_first) + 7 for (own, _), x in obs.items() if own == trip}:
                if t != o.t_first and (later is None or not o.t_first < t < later.t_first):
                    continue
                stay = min(o.t_last, later.t_first) if later else o.t_last
                for states, w in weights.items():
                    i = states[n]
                    if t <= max(stay, o.t_first):
                        placed = [(offsets[trip, k, i], 1.0)]
                    else:
                        found = cells[trip, k][i, states[n + 1]]
                        placed = []
                        for p, q in found:
                            r = paths[trip, k, p]
                            frac = min(max((t - stay) / r.budget_s, 0), 1) if r.ett_s > 0 and r.budget_s > 0 else 0.0
                            ends = ((r.edges[0], r.start_offset), (r.edges[-1], r.end_offset))
                            placed.append((ends[frac >= 0.5] if r.off_road else walked(r, lengths, frac), q / sum(x for _, x in found)))
                    for (link, offset), q in placed:
                        want[trip, t, link][0] += w / z * q
                        want[trip, t, link][1] += w / z * q * offset
    got = collections.defaultdict(lambda: [0.0, 0.0])
    for r in registry.reconstruct_at_time(spark, few).collect():
        got[r.trip_id, r.t, r.link_id][0] += r.prob
        got[r.trip_id, r.t, r.link_id][1] += r.prob * r.offset_m
    assert {5, 33, 1007} == {trip for trip, _, _ in got}
    for key in want.keys() | got.keys():
        assert got[key] == pytest.approx(want[key], abs=1e-2), key


@pytest.mark.parametrize("name", ["path_scores", "topk_rank", "edge_marginals", "calibration_bins", "calibration_error", "cluster_paths", "diversity_filter"])
def test_all_records_against_sql(spark, name):
    assert registry._records(spark, SF, True).select("trip_id").distinct().count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert plain(registry.queries()[f"{name}_all"](spark, SF).toPandas()) == plain(by_sql(f"{name}_all"))


@pytest.mark.parametrize("name", ["emission_logpdf_all", "porto_explode_all"])
def test_all_pings_against_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert got["seq"].max() > 12
    assert plain(got) == plain(by_sql(name))


def test_candidate_paths_of_all_transitions(spark, tmp_path, monkeypatch):
    """Transitions past the sixth have paths, up to the default number of them."""
    few = str(tmp_path)
    spark.range(40).selectExpr("500 + id AS event_id", "timestamp_seconds(id) AS ts", "5L AS user_id", "10D AS value").write.parquet(f"{few}/events.parquet")
    seen = []
    own = registry.routing.candidate_paths
    monkeypatch.setattr(registry.routing, "candidate_paths", lambda states, rows, edges, cfg: seen.append((rows, cfg)) or own(states, rows, edges, cfg))
    got = registry.candidate_paths_full(spark, few).groupBy("trip_id", "k").count().collect()
    (rows, cfg), = seen
    runs = registry._flagged(spark, few).select("trip_id", "k").collect()
    assert cfg.max_path_candidates == 100 and sorted((r.trip_id, r.k) for r in rows.collect()) == sorted((r.trip_id, r.k) for r in runs)
    assert max(r.k for r in got) > 5 and 12 < max(r["count"] for r in got) <= 100
