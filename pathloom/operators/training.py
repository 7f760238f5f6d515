"""Fitting the route weights: distributed gradients, a small optimiser on the driver.

Each step sums the gradient over trips on the executors; only N_FEATURES + 2 numbers return.
Tables: states (trip_id, k, i, distance_m, label), cells (trip_id, k, i, j, path_id, phi, label),
where label marks the true state of an observation and the true path of a transition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.config import N_FEATURES, VIOLATION_DEFAULT, Config
from pathloom.functions import geo
from pathloom.operators import inference
from pathloom.sources.work import kept

SCALE_BOUNDS = (2.0, 1000.0)
OUT = "nll double, grad array<double>"


def student_t(d: np.ndarray, scale: float, df: float) -> tuple[np.ndarray, np.ndarray]:
    """Log density of distances and its derivative by log scale."""
    from math import lgamma, log, pi

    norm = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * pi) - log(scale)
    return norm - (df + 1) / 2 * np.log1p((d / scale) ** 2 / df), -1 + (df + 1) * d * d / (df * scale * scale + d * d)


def trip_gradient(states: pd.DataFrame, cells: pd.DataFrame, mu: np.ndarray, scale: float, df: float) -> tuple[float, np.ndarray]:
    """Negative log likelihood of a trip's labels and its gradient by mu and log scale; nothing for a trip whose labels cannot be joined."""
    states = states.sort_values(["k", "i"])
    log_e, slope = student_t(states["distance_m"].to_numpy(float), scale, df)
    states = states.assign(e=log_e, g=slope)
    by_k = [g for _, g in states.groupby("k")]
    phi = np.stack(cells["phi"].to_numpy()) if len(cells) else np.zeros((0, N_FEATURES))
    score = phi @ mu
    k0 = int(states["k"].min())
    at = (cells["k"].to_numpy(int) - k0, cells["i"].to_numpy(int), cells["j"].to_numpy(int))
    m = [np.full((len(a), len(b)), -np.inf) for a, b in zip(by_k, by_k[1:], strict=False)]
    for k, i, j, s in zip(*at, score, strict=True):
        m[k][i, j] = np.logaddexp(m[k][i, j], s)
    alpha, beta, log_z = inference.forward_backward([g["e"].to_numpy() for g in by_k], m)
    # A path that joins several cells is one path: its label counts once.
    true = cells[cells["label"]].drop_duplicates("k")
    own = states[states["label"]]
    if not np.isfinite(log_z) or len(true) != len(m) or len(own) != len(by_k):
        return 0.0, np.zeros(N_FEATURES + 1)
    weight = np.array([np.exp(alpha[k][i] + s + by_k[k + 1]["e"].to_numpy()[j] + beta[k + 1][j] - log_z) for k, i, j, s in zip(*at, score, strict=True)])
    q = np.concatenate([np.exp(a + b - log_z) for a, b in zip(alpha, beta, strict=True)])
    true_phi = np.stack(true["phi"].to_numpy()) if len(true) else np.zeros((0, N_FEATURES))
    nll = log_z - float(own["e"].sum()) - float((true_phi @ mu).sum())
    return nll, np.append(weight @ phi - true_phi.sum(axis=0), q @ states["g"].to_numpy() - float(own["g"].sum()))


def gradient(states: DataFrame, cells: DataFrame, mu: np.ndarray, scale: float, df: float = 4.0) -> tuple[float, np.ndarray]:
    """Sums of trip_gradient() over all trips."""

    def run(_, own: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"nll": [], "grad": []})
        nll, g = trip_gradient(own, between, mu, scale, df)
        return pd.DataFrame({"nll": [nll], "grad": [g.tolist()]})

    rows = states.groupBy("trip_id").cogroup(cells.groupBy("trip_id")).applyInPandas(run, OUT)
    total = rows.agg(F.sum("nll").alias("nll"), *(F.sum(F.col("grad")[i]).alias(f"g{i}") for i in range(N_FEATURES + 1))).first()
    return float(total.nll or 0.0), np.array([total[f"g{i}"] or 0.0 for i in range(N_FEATURES + 1)])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int, tolerance: float = 1e-5, memory: int = 10) -> tuple[np.ndarray, bool]:
    """Projected limited-memory BFGS with a backtracking search; the point and whether it converged."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if np.abs(g[free]).max(initial=0.0) < tolerance:
            return x, True
        d, steps = np.where(free, g, 0.0), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            steps.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(steps), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        d = np.where(free, d, 0.0)
        if d @ g <= 0:
            d, pairs = np.where(free, g, 0.0), []
        step = 1.0 if pairs else min(1.0, 1.0 / max(1e-12, np.abs(d).sum()))
        for _ in range(30):
            new = np.clip(x - step * d, lo, hi)
            new_value, new_g = f(new)
            if new_value <= value - 1e-4 * (g @ (x - new)):
                break
            step /= 2
        else:
            return x, False
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - new_value) <= tolerance * 1e-4 * max(1.0, abs(value))
        x, value, g = new, new_value, new_g
        if done:
            return x, True
    return x, False


def fit_supervised(states: DataFrame, cells: DataFrame, mu: tuple[float, ...] | None = None, scale: float = 10.0, rounds: int = 200, l2: float = 1e-4, fix_scale: float | None = None, df: float = 4.0) -> tuple[tuple[float, ...], float, bool]:
    """Weights, emission scale and whether the fit converged. Without a violating candidate the last weight is pinned, as nothing tells it."""
    states, cells = kept(states, "train-states"), kept(cells, "train-cells")
    start = np.append(np.zeros(N_FEATURES) if mu is None else np.array(mu, float), np.log(fix_scale or scale))
    lo, hi = np.full(N_FEATURES + 1, -np.inf), np.full(N_FEATURES + 1, np.inf)
    lo[-1], hi[-1] = (np.log(fix_scale),) * 2 if fix_scale else np.log(SCALE_BOUNDS)
    if cells.where(F.col("phi")[18] > 0).limit(1).count() == 0:
        start[18] = lo[18] = hi[18] = VIOLATION_DEFAULT

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        nll, g = gradient(states, cells, x[:-1], float(np.exp(x[-1])), df)
        return nll + 0.5 * l2 * float(x[:-1] @ x[:-1]), g + np.append(l2 * x[:-1], 0.0)

    x, ok = minimise(f, np.clip(start, lo, hi), lo, hi, rounds)
    return tuple(x[:-1]), float(np.exp(x[-1])), ok


def labelled(run, distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels from a run's own best sequences, for segments that are a trip's only one: the tables of fit_supervised(). distances: trip_id, k, i, distance_m."""
    whole = run.inferred.groupBy("trip_id").agg(F.countDistinct("seg").alias("n"), F.count_if("mle").alias("m")).where("n = 1 and m > 1").select("trip_id")
    best = run.inferred.where("mle").select("trip_id", "k", "i", F.lit(True).alias("label"), F.col("mle_path").alias("path_id"))
    states = distances.join(whole, "trip_id").join(best.select("trip_id", "k", "i", "label"), ["trip_id", "k", "i"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
    cells = run.cells.join(whole, "trip_id").join(run.paths.select("trip_id", "k", "path_id", "phi"), ["trip_id", "k", "path_id"]).join(best.select("trip_id", "k", "path_id", "label"), ["trip_id", "k", "path_id"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
    return states.select("trip_id", "k", "i", "distance_m", "label"), cells.select("trip_id", "k", "i", "j", "path_id", "phi", "label")


def fit_em(reconstructed: Callable[[Config], object], distances: Callable[[object], DataFrame], cfg: Config, rounds: int = 50, tolerance: float = 1e-4) -> Config:
    """Hard EM: best sequences under the current weights become labels of the next fit, until the summed log Z settles."""
    from dataclasses import replace

    before = None
    for _ in range(rounds):
        run = reconstructed(cfg)
        total = run.inferred.groupBy("trip_id", "seg").agg(F.max("log_z").alias("z")).agg(F.sum("z").alias("z")).first().z
        if before is not None and abs(total - before) < tolerance:
            break
        before = total
        mu, scale, _ = fit_supervised(*labelled(run, distances(run)), cfg.mu(), cfg.emission_scale)
        cfg = replace(cfg, weights=mu, emission_scale=scale)
    return cfg


# Labels of sparse candidates from a dense run


def closest_state(states: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """trip_id, k, i: the candidate on the true link nearest in offset, else on its twin with the offset turned round."""
    own = edges.select("link_id", "twin", F.col("length_m").alias("__len"))
    t = truth.select("trip_id", "k", F.col("link_id").alias("__link"), F.col("offset_m").alias("__off")).join(own.withColumnRenamed("link_id", "__link"), "__link")
    rows = states.join(t, ["trip_id", "k"])
    rank = F.when(F.col("link_id") == F.col("__link"), 0).when(F.col("link_id") == F.col("twin"), 1)
    gap = F.abs(F.col("offset_m") - F.when(rank == 1, F.col("__len") - F.col("__off")).otherwise(F.col("__off")))
    return rows.withColumn("__r", rank).where("__r is not null").groupBy("trip_id", "k").agg(F.min_by("rank", F.struct("__r", gap, "rank")).alias("i"))


def best_path_by_overlap(paths: DataFrame, truth: DataFrame) -> DataFrame:
    """trip_id, k, path_id: the largest Jaccard index of keys with truth (trip_id, k, segs), then the shorter; the shortest without truth. paths have segs."""
    rows = paths.join(truth.select("trip_id", "k", F.col("segs").alias("__t")), ["trip_id", "k"], "left")
    jac = F.when(F.size("__t") > 0, 1 - geo.jaccard_distance(F.col("segs"), F.col("__t"))).otherwise(0.0)
    return rows.groupBy("trip_id", "k").agg(F.max_by("path_id", F.struct(jac, -F.col("length_m"), -F.col("path_id"))).alias("path_id"))


def best_path_by_pings(distances: DataFrame) -> DataFrame:
    """trip_id, k, path_id: the smallest largest distance of pings to the path, then the shorter. distances: trip_id, k, path_id, distance_m, length_m."""
    worst = distances.groupBy("trip_id", "k", "path_id").agg(F.max("distance_m").alias("d"), F.first("length_m").alias("m"))
    return worst.groupBy("trip_id", "k").agg(F.min_by("path_id", F.struct("d", "m", "path_id")).alias("path_id"))


def truth_in_window(windows: DataFrame, truth: DataFrame) -> DataFrame:
    """trip_id, k, segs: keys of true pieces (trip_id, lo, hi, segs) that overlap a window (trip_id, k, w_lo, w_hi)."""
    rows = windows.join(truth, "trip_id").where("lo < w_hi and hi > w_lo")
    return rows.groupBy("trip_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("segs"))).alias("segs"))


def viable_runs(labels: DataFrame, least: int = 3) -> DataFrame:
    """trip_id, run, k of stretches of consecutive labelled observations with at least `least` of them."""
    w = Window.partitionBy("trip_id").orderBy("k")
    rows = labels.withColumn("run", F.col("k") - F.row_number().over(w))
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy("trip_id", "run"))).where(F.col("__n") >= least).select("trip_id", "run", "k")
