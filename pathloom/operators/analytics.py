"""Calibration, clustering, diversity and error tables over weighed candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.functions.batches import whole_groups

# Edges of the reliability bins.
BINS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0001)


def bin_of(p: Column) -> Column:
    p = F.round(p, 9)
    return sum((p >= b).cast("int") for b in BINS[1:-1])


def edge_marginals(records: DataFrame) -> DataFrame:
    """trip_id, k, seg, prob (at most 1), on_truth for each edge of any candidate."""
    rows = records.select("trip_id", "k", "prob", "truth", F.explode(F.array_distinct("segs")).alias("seg"))
    return rows.groupBy("trip_id", "k", "seg").agg(F.least(F.sum("prob"), F.lit(1.0)).alias("prob"), F.max(F.array_contains("truth", F.col("seg"))).alias("on_truth"))


def missed_edges(records: DataFrame) -> DataFrame:
    """trip_id, k, missed: true edges that no candidate has."""
    rows = records.groupBy("trip_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("segs"))).alias("s"), F.first("truth").alias("t"))
    return rows.select("trip_id", "k", F.size(F.array_except("t", "s")).alias("missed"))


def sum_and_max(directed: DataFrame) -> DataFrame:
    """Undirected marginals from directed ones (trip_id, k, link_id, seg, prob), folded by sum and by maximum."""
    return directed.groupBy("trip_id", "k", "seg").agg(F.least(F.sum("prob"), F.lit(1.0)).alias("by_sum"), F.max("prob").alias("by_max"))


def reliability(rows: DataFrame) -> DataFrame:
    """bin, n, stated and observed of rows (prob, on_truth)."""
    return rows.groupBy(bin_of(F.col("prob")).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("stated"), F.avg(F.col("on_truth").cast("double")).alias("observed"))


def calibration_error(rows: DataFrame) -> DataFrame:
    """ece: mean gap of the bins, weighed by their rows, in points."""
    return reliability(rows).agg((100 * F.sum(F.col("n") * F.abs(F.col("stated") - F.col("observed"))) / F.sum("n")).alias("ece"))


def isotonic(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """prob, rescaled: the monotone fit of on_truth to prob (pool adjacent violators), one row for each distinct prob."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    table = VectorAssembler(inputCols=["prob"], outputCol="features").transform(rows.withColumn("label", F.col("on_truth").cast("double")))
    model = IsotonicRegression(weightCol=weight) if weight else IsotonicRegression()
    return model.fit(table).transform(table).select("prob", F.col("prediction").alias("rescaled")).distinct()


def _shared(segs: pa.ListArray, starts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in groups (rank: a row's place in its group) the place of each row's first pair, and of each pair of a row and an earlier one of its group the sizes of intersection and union of their sets."""
    n = len(rank)
    codes = segs.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.unique(np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(segs), 0).to_numpy(zero_copy_only=False)) * (m := int(codes.max(initial=0)) + 1) + codes)
    row, code = held // m, held % m
    size = np.bincount(row, minlength=n)
    # Rows of a group that have an element, next to each other and in order.
    own = starts[row] * m + code
    order = np.argsort(own, kind="stable")
    row, new = row[order], np.r_[True, np.diff(own[order]) != 0][: len(own)]
    place = np.arange(len(row))
    before = place - np.maximum.accumulate(np.where(new, place, 0))
    later = np.repeat(place, before)
    earlier = later - 1 - (np.arange(len(later)) - np.repeat(np.cumsum(before) - before, before))
    base = np.cumsum(rank) - rank
    both = np.bincount(base[row[later]] + rank[row[earlier]], minlength=int(rank.sum()))
    b = np.repeat(np.arange(n), rank)
    a = starts[b] + np.arange(len(b)) - base[b]
    return base, both, size[a] + size[b] - both


def _linked(segs: pa.ListArray, starts: np.ndarray, rank: np.ndarray, tau: float) -> np.ndarray:
    """Group-relative number (of its first row) of each row's cluster."""
    base, both, union = _shared(segs, starts, rank)
    near = (union == 0) | (1 - both / np.maximum(union, 1) <= tau)
    own = rank.copy()
    for r in range(1, int(rank.max(initial=0)) + 1):
        at = np.flatnonzero(rank == r)
        earlier = starts[at][:, None] + np.arange(r)
        on, labels = near[base[at][:, None] + np.arange(r)], own[earlier]
        least = np.where(on, labels, r).min(axis=1)
        joined = np.zeros((len(at), r), bool)
        i, j = np.nonzero(on)
        joined[i, labels[i, j]] = True
        own[earlier] = np.where(np.take_along_axis(joined, labels, 1), least[:, None], labels)
        own[at] = least
    return own


def _taken(segs: pa.ListArray, starts: np.ndarray, rank: np.ndarray, most: int, tau: float) -> np.ndarray:
    """Place of each row among those taken in its group, 0 if it isn't."""
    base, both, union = _shared(segs, starts, rank)
    near = ~(1 - both / np.maximum(union, 1) >= tau)
    out = np.zeros(len(rank), np.int64)
    for r in range(int(rank.max(initial=0)) + 1):
        at = np.flatnonzero(rank == r)
        earlier = out[starts[at][:, None] + np.arange(r)] > 0
        n = earlier.sum(axis=1)
        ok = (n < most) & ~(earlier & near[base[at][:, None] + np.arange(r)]).any(axis=1)
        out[at] = np.where(ok, n + 1, 0)
    return out


def _groups(records: DataFrame, order: list[Column | str], run, out: str) -> DataFrame:
    """run(rows, starts, rank) over many whole transitions at once, each in order; a transition has at most Config.max_path_candidates paths, so a group is small."""
    # The window brings transitions together, in the shuffle that the records may already have, and tells where they begin.
    n = F.row_number().over(Window.partitionBy("trip_id", "k").orderBy(*order))
    rows = records.select("trip_id", "k", "path_id", "prob", "segs").withColumn("__n", n).select("trip_id", "k", "path_id", "segs", "__n")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_groups(parts, 4):
            rank = own.column(4).to_numpy().astype(np.int64) - 1
            yield run(own, np.arange(len(rank)) - rank, rank)

    return rows.mapInArrow(batches, out)


def clusters(records: DataFrame, tau: float) -> DataFrame:
    """path_id, cluster (its smallest path): single linkage of a transition's paths at Jaccard distance tau."""

    def run(rows: pa.RecordBatch, starts: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        own = _linked(rows.column(3), starts, rank, tau)
        return pa.RecordBatch.from_arrays([*rows.columns[:3], rows.column(2).take(pa.array(starts + own))], ["trip_id", "k", "path_id", "cluster"])

    return _groups(records, ["path_id"], run, "trip_id long, k long, path_id long, cluster long")


def cluster_scores(records: DataFrame, tau: float, match: float = 0.5) -> DataFrame:
    """For each transition the top path's and the top cluster's probability, and whether they match the truth."""
    rows = records.join(clusters(records, tau), ["trip_id", "k", "path_id"])
    jac = F.size(F.array_intersect("segs", "truth")) / F.greatest(F.size(F.array_union("segs", "truth")), F.lit(1))
    rows = rows.withColumn("hit", jac >= match)
    by_cluster = rows.groupBy("trip_id", "k", "cluster").agg(F.sum("prob").alias("p"), F.max_by("hit", F.struct("prob", -F.col("path_id"))).alias("hit"))
    top = by_cluster.groupBy("trip_id", "k").agg(F.max("p").alias("cluster_prob"), F.max_by("hit", F.struct("p", -F.col("cluster"))).alias("cluster_hit"), F.sum(-F.col("p") * F.log("p")).alias("cluster_entropy"))
    one = rows.groupBy("trip_id", "k").agg(F.max("prob").alias("path_prob"), F.max_by("hit", F.struct("prob", -F.col("path_id"))).alias("path_hit"), F.sum(-F.col("prob") * F.log("prob")).alias("path_entropy"))
    return one.join(top, ["trip_id", "k"])


def diverse(records: DataFrame, most: int, tau: float) -> DataFrame:
    """path_id, place: greedily by prob, paths at Jaccard distance tau or more from all taken before, up to `most`."""

    def run(rows: pa.RecordBatch, starts: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        place = _taken(rows.column(3), starts, rank, most, tau)
        return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(place)], ["trip_id", "k", "path_id", "place"]).filter(pa.array(place > 0))

    prob = F.when(~F.isnan("prob"), F.col("prob"))
    return _groups(records, [prob.desc_nulls_last(), F.col("path_id")], run, "trip_id long, k long, path_id long, place long")


def overlap_sum(windows: DataFrame, stays: DataFrame) -> DataFrame:
    """windows (trip_id, w, w_lo, w_hi) with the summed dwell_s of stays (trip_id, lo, hi, dwell_s) that overlap them."""
    rows = windows.join(stays, "trip_id", "left").where("lo is null or (lo < w_hi and hi > w_lo)")
    met = rows.groupBy("trip_id", "w").agg(F.sum("dwell_s").alias("dwell_s"))
    return windows.select("trip_id", "w").join(met, ["trip_id", "w"], "left").withColumn("dwell_s", F.coalesce("dwell_s", F.lit(0.0)))


def stats(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("max"))


def rule_errors(rows: DataFrame, key: list[str], rules: list[str]) -> DataFrame:
    """Median error of each rule and of the best rule of each row, and how often the first one wins."""
    best = F.least(*rules)
    return rows.withColumn("__o", best).groupBy(*key).agg(F.count("*").alias("n"), *(F.median(r).alias(f"{r}_median") for r in rules), F.median("__o").alias("oracle_median"), F.percentile("__o", 0.95).alias("oracle_p95"), F.sum((F.col(rules[0]) == F.col("__o")).cast("long")).alias(f"{rules[0]}_wins"))


def state_entropy(marginals: DataFrame) -> DataFrame:
    """trip_id, k, entropy (nats) of state marginals."""
    return marginals.groupBy("trip_id", "k").agg(F.sum(F.when(F.col("prob") > 0, -F.col("prob") * F.log("prob")).otherwise(0.0)).alias("entropy"))


def differing_runs(rows: DataFrame, key: list[str]) -> DataFrame:
    """Runs of consecutive k at which a and b differ: key, k_first, k_last."""
    w = Window.partitionBy(*key).orderBy("k")
    rows = rows.where("a <> b").withColumn("__g", F.col("k") - F.row_number().over(w))
    return rows.groupBy(*key, "__g").agg(F.min("k").alias("k_first"), F.max("k").alias("k_last")).drop("__g")


def capacity(distances: DataFrame, delta_m: float, teleport_m: float = 250.0) -> DataFrame:
    """Class of each transition from the distances of its pings to its candidates (trip_id, k, path_id, seq, distance_m, hop_m).

    capacity_ok: one candidate is near all pings; on_footprint_split: each ping is near some candidate; off_footprint_excursion: inner pings are near none;
    generator_gap: the rest. data_gap comes first, where a hop is a teleport.
    """
    per_path = distances.groupBy("trip_id", "k", "path_id").agg(F.max("distance_m").alias("worst"))
    best = per_path.groupBy("trip_id", "k").agg(F.min("worst").alias("best"))
    per_ping = distances.groupBy("trip_id", "k", "seq").agg(F.min("distance_m").alias("d"), F.max("hop_m").alias("hop"))
    ping = per_ping.groupBy("trip_id", "k").agg(F.max("d").alias("farthest"), F.avg((F.col("d") > delta_m).cast("double")).alias("off"), F.max("hop").alias("hop"))
    kind = F.when(F.col("hop") > teleport_m, "data_gap").when(F.col("best") <= delta_m, "capacity_ok").when(F.col("farthest") <= delta_m, "on_footprint_split").when(F.col("off") >= 0.5, "off_footprint_excursion").otherwise("generator_gap")
    return best.join(ping, ["trip_id", "k"]).select("trip_id", "k", kind.alias("capacity"))


def class_mix(rows: DataFrame) -> DataFrame:
    """road_class, share over edge marginals in the middle bin and over all (full outer)."""
    share = lambda x, n: x.groupBy("road_class").agg(F.count("*").alias("c")).withColumn(n, F.col("c") / F.sum("c").over(Window.partitionBy())).drop("c")
    return share(rows.where("prob >= 0.4 and prob < 0.6"), "mid").join(share(rows, "all"), "road_class", "full")


def composition(marginals: DataFrame, cells: DataFrame) -> DataFrame:
    """trip_id, composes: whether the states that are best one by one also form a sequence of existing cells."""
    best = marginals.groupBy("trip_id", "k").agg(F.max_by("i", F.struct("prob", -F.col("i"))).alias("i"))
    nxt = best.select("trip_id", (F.col("k") - 1).alias("k"), F.col("i").alias("j"))
    steps = best.join(nxt, ["trip_id", "k"]).join(cells.select("trip_id", "k", "i", "j").distinct().withColumn("__ok", F.lit(1)), ["trip_id", "k", "i", "j"], "left")
    return steps.groupBy("trip_id").agg(F.min(F.coalesce("__ok", F.lit(0))).cast("boolean").alias("composes"))


def separated(rows: DataFrame, value: str, most: int, least_gap: int) -> DataFrame:
    """Rows (trip_id, k, value) taken greedily by value, each at least least_gap places from those taken before, up to `most` a trip."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        for k in part.sort_values([value, "k"], ascending=[False, True])["k"]:
            if len(taken) < most and all(abs(k - x) >= least_gap for x in taken):
                taken.append(k)
        return part[part["k"].isin(taken)]

    return rows.groupBy("trip_id").applyInPandas(run, rows.schema)


def downsampled_dwells(obs: DataFrame) -> DataFrame:
    """trip_id, t_lo, t_hi, dwell_s of each transition."""
    w = Window.partitionBy("trip_id").orderBy("k")
    return obs.withColumn("t_hi", F.lead("t_first").over(w)).where("t_hi is not null").select("trip_id", F.col("t_first").alias("t_lo"), "t_hi", "dwell_s")


def candidate_dwells(paths: DataFrame, marginals: DataFrame) -> DataFrame:
    """trip_id, k, expected_dwell_s: path probabilities, normalised, times what each path leaves of the budget."""
    rows = paths.join(marginals.select("trip_id", "k", "path_id", "prob"), ["trip_id", "k", "path_id"])
    left = F.greatest(F.col("budget_s") - F.col("ett_s"), F.lit(0.0))
    return rows.groupBy("trip_id", "k").agg((F.sum(F.col("prob") * left) / F.sum("prob")).alias("expected_dwell_s"))


def position_errors(places: DataFrame, truth: DataFrame) -> DataFrame:
    """trip_id, t, error_m of places (trip_id, t, lat, lon) against true ones."""
    t = truth.select("trip_id", "t", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    return places.join(t, ["trip_id", "t"]).select("trip_id", "t", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")).alias("error_m"))
