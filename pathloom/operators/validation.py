"""Validation: baselines, hold-outs, sign gates, and scores of weighed candidates against truth.

Records are rows (trip_id, k, path_id, prob, segs, truth) with edge keys as arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.config import FEATURES
from pathloom.functions import geo
from pathloom.operators import network

# Expected signs of the weights by slot; others may have any.
NEGATIVE_OR_ZERO = (0, 13, 14, 15, 16, 18)
SIGN_EPSILON = 1e-6


def snap(obs: DataFrame, edges: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """The nearest edge of each observation (trip_id, k, lat, lon); null beyond the radius."""
    return network.nearest_edge(obs, edges, ["trip_id", "k"], radius_m)


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """trip_id, rate: share of observations with both links known whose links differ; 0 if there are none."""
    both = a.select("trip_id", "k", F.col("link_id").alias("x")).join(b.select("trip_id", "k", F.col("link_id").alias("y")), ["trip_id", "k"])
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    return both.groupBy("trip_id").agg(F.coalesce(F.avg(F.when(known, (F.col("x") != F.col("y")).cast("double"))), F.lit(0.0)).alias("rate"))


def miss_rate(found: Column, truth: Column) -> Column:
    """Share of true edges that are not found; 0 without truth."""
    n = F.size(F.array_distinct(truth))
    return F.when(n > 0, F.size(F.array_except(truth, found)) / n).otherwise(0.0)


def path_scores(records: DataFrame) -> DataFrame:
    """For each transition: miss_rate of the best path by overlap, its Jaccard index and id (ties: fewer edges, then id), and the entropy of prob."""
    jac = F.size(F.array_intersect("segs", "truth")) / F.greatest(F.size(F.array_union("segs", "truth")), F.lit(1))
    rows = records.withColumn("__j", jac)
    return rows.groupBy("trip_id", "k").agg(
        F.max_by(F.struct(miss_rate(F.col("segs"), F.col("truth")).alias("m"), F.col("__j").alias("j"), "path_id"), F.struct("__j", -F.size("segs"), -F.col("path_id"))).alias("b"),
        F.sum(F.when(F.col("prob") > 0, -F.col("prob") * F.log("prob")).otherwise(0.0)).alias("entropy"),
    ).select("trip_id", "k", F.col("b.m").alias("miss_rate"), F.col("b.j").alias("best_jaccard"), F.col("b.path_id").alias("best_path"), "entropy")


def truth_rank(records: DataFrame, level: float = 0.9) -> DataFrame:
    """truth_rank: place by prob of the first path that equals the truth (null if none); covered: it lies in the smallest set of probability `level`."""
    w = Window.partitionBy("trip_id", "k").orderBy(F.desc("prob"), "path_id")
    before = F.coalesce(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = records.withColumns({"__n": F.row_number().over(w), "__before": before})
    same = (F.size(F.array_except("segs", "truth")) == 0) & (F.size(F.array_except("truth", "segs")) == 0)
    return rows.groupBy("trip_id", "k").agg(F.min(F.when(same, F.col("__n"))).cast("long").alias("truth_rank"), F.coalesce(F.max(F.when(same, F.col("__before") < level - 1e-12)), F.lit(False)).alias("covered"))


def point_miss_rate(points: DataFrame, path_edges: DataFrame, edges: DataFrame, threshold_m: float = 20.0) -> DataFrame:
    """trip_id, rate: share of points (trip_id, k, lat, lon) farther than the threshold from all edges (trip_id, link_id) of the trip's path."""
    near = distance_to_edges(points, path_edges, edges)
    return near.groupBy("trip_id").agg(F.avg(F.when(F.col("distance_m") <= threshold_m, 0.0).otherwise(1.0)).alias("rate"))


def distance_to_edges(points: DataFrame, path_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """trip_id, k, distance_m to the nearest of a trip's edges; null if none is known."""
    own = path_edges.select("trip_id", "link_id").distinct().join(edges.select("link_id", "coords", "length_m"), "link_id")
    far = points.join(own, "trip_id", "left").withColumn("__d", geo.projected(F.col("coords"), F.col("length_m"), F.col("lat"), F.col("lon"))["perp_m"])
    return far.groupBy("trip_id", "k").agg(F.min("__d").alias("distance_m"))


def nearest_in_time(rows: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """rows (trip_id, t) with the value of truth (trip_id, t, value) nearest in time, the earlier on ties.

    A last-before and a first-after value over the time-ordered union: linear in the rows.
    """
    both = rows.select("trip_id", "t", F.struct(*key).alias("__key"), F.lit(None).cast("struct<t:double,value:bigint>").alias("__v")).unionByName(
        truth.select("trip_id", "t", F.lit(None).cast(rows.select(F.struct(*key)).schema[0].dataType).alias("__key"), F.struct(F.col("t").cast("double").alias("t"), F.col("value").cast("long").alias("value")).alias("__v"))
    )
    w = Window.partitionBy("trip_id").orderBy("t")
    a = F.last("__v", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    b = F.first("__v", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"__a": a, "__b": b}).where("__key is not null")
    nearer = F.when(F.col("__a").isNull() | (F.col("__b.t") - F.col("t") < F.col("t") - F.col("__a.t")), F.col("__b.value")).otherwise(F.col("__a.value"))
    return both.select("__key.*", *([] if "trip_id" in key else ["trip_id"]), nearer.alias("value"))


def covering_segment(times: DataFrame, segments: DataFrame) -> DataFrame:
    """times (trip_id, t) with the segment (trip_id, seg, t_from, t_to) that covers t, else the one with the smallest gap; ties to the first."""
    gap = F.greatest(F.col("t_from") - F.col("t"), F.col("t") - F.col("t_to"), F.lit(0.0))
    rows = times.join(segments.select("trip_id", "seg", "t_from", "t_to"), "trip_id")
    return rows.groupBy("trip_id", "t").agg(F.min_by("seg", F.struct(gap, "seg")).alias("seg"))


def hold_out(pings: DataFrame, fraction: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Kept and masked pings: the ends of each trip of 4 or more, or a share of the inner pings of trips of 6 or more, chosen by hash."""
    w = Window.partitionBy("trip_id")
    rows = pings.withColumns({"__i": F.row_number().over(w.orderBy("seq")), "__n": F.count("*").over(w)})
    end = (F.col("__i") == 1) | (F.col("__i") == F.col("__n"))
    if fraction is None:
        rows, masked = rows.where("__n >= 4"), end
    else:
        rows = rows.where("__n >= 6")
        order = F.row_number().over(w.orderBy(end.cast("int"), F.xxhash64(F.lit(seed), "trip_id", "seq")))
        masked = (order <= F.greatest(F.lit(1), F.floor((F.col("__n") - 2) * fraction))) & ~end
    rows = rows.withColumn("__masked", masked)
    return rows.where("not __masked").drop("__i", "__n", "__masked"), rows.where("__masked").drop("__i", "__n", "__masked")


def hold_out_errors(pings: DataFrame, edges: DataFrame, run: Callable[[DataFrame], object], fraction: float | None = None, seed: int = 42) -> DataFrame:
    """trip_id, k, distance_m of masked pings to the most likely edges of the nearest segment of run(kept)."""
    kept, masked = hold_out(pings, fraction, seed)
    found = run(kept)
    spans = found.segments().select("trip_id", "seg", "t_from", "t_to")
    at = masked.select("trip_id", F.col("seq").alias("k"), "t", "lat", "lon")
    at = at.join(covering_segment(at.select("trip_id", "t"), spans), ["trip_id", "t"])
    links = segment_edges(found.most_likely())
    far = at.join(links, ["trip_id", "seg"]).join(edges.select("link_id", "coords", "length_m"), "link_id")
    return far.groupBy("trip_id", "k").agg(F.min(geo.projected(F.col("coords"), F.col("length_m"), F.col("lat"), F.col("lon"))["perp_m"]).alias("distance_m"))


def segment_edges(most_likely: DataFrame) -> DataFrame:
    """trip_id, seg, link_id: the distinct edges of most likely states and paths."""
    links = F.explode(F.array_union(F.array("link_id"), F.coalesce("edges", F.array().cast("array<long>"))))
    return most_likely.select("trip_id", "seg", links.alias("link_id")).distinct()


def weight_signs(spark: SparkSession, mu: tuple[float, ...]) -> DataFrame:
    """slot, name, weight, ok for each weight."""
    rows = [(i, FEATURES[i], float(w), not (i in NEGATIVE_OR_ZERO and w > SIGN_EPSILON)) for i, w in enumerate(mu)]
    return spark.createDataFrame(rows, "slot int, name string, weight double, ok boolean")


def scale_ok(scale: Column, lo: float = 0.5, hi: float = 100.0) -> Column:
    """struct(ok, note) of an emission scale."""
    note = F.when(scale < lo, "below the range").when(scale > hi, "above the range").when(scale < 3, "small").when(scale > 30, "large").otherwise("")
    return F.struct(((scale >= lo) & (scale <= hi)).alias("ok"), note.alias("note"))
