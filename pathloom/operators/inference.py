"""Sum-product and max-product over the trellis of each trip.

A trip's trellis is a handful of states for each observation; the recursions run by trip over
numpy arrays, many trips to a batch, and what is wide (path marginals) is joined back outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.batches import whole_groups

OUT = "trip_id long, seg int, k long, i int, log_e double, alpha double, beta double, log_z double, prob double, mle boolean, mle_path long, cliff boolean"


def log_sum(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - safe), axis=axis, keepdims=True)) + safe
    return np.squeeze(out, axis=axis) if axis is not None else out.item()


def forward_backward(e: list[np.ndarray], m: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """alpha, beta and log Z of emissions e and transitions m, all in logs."""
    alpha = [e[0]]
    for k, x in enumerate(m):
        alpha.append(e[k + 1] + log_sum(alpha[k][:, None] + x, 0))
    beta = [np.zeros(len(e[-1]))]
    for k in range(len(m) - 1, -1, -1):
        beta.append(log_sum(m[k] + (e[k + 1] + beta[-1])[None, :], 1))
    return alpha, beta[::-1], float(log_sum(alpha[-1], 0)) if len(alpha[-1]) else float("-inf")


def best_sequences(e: list[np.ndarray], m: list[np.ndarray | None]) -> list[tuple[int, list[int]]]:
    """Max-product with restarts: (first observation, states) of each stretch. A stretch ends where no transition has weight; observations without states are passed over.

    A stretch whose last emissions are all impossible is lost, as nothing can be traced back.
    """
    out: list[tuple[int, list[int]]] = []

    def trace(first: int, delta: list[np.ndarray], back: list[np.ndarray]) -> None:
        if np.isfinite(delta[-1]).any():
            states = [int(np.argmax(delta[-1]))]
            for b in reversed(back):
                states.append(int(b[states[-1]]))
            out.append((first, states[::-1]))

    k = 0
    while k < len(e):
        if not len(e[k]):
            k += 1
            continue
        first, delta, back = k, [e[k]], []
        while k + 1 < len(e) and len(e[k + 1]) and m[k] is not None:
            both = delta[-1][:, None] + m[k]
            if not np.isfinite(both).any():
                break
            back.append(np.argmax(both, axis=0))
            delta.append(e[k + 1] + np.max(both, axis=0))
            k += 1
        trace(first, delta, back)
        k += 1
    return out


def top_sequences(e: list[np.ndarray], m: list[np.ndarray], most: int) -> list[tuple[float, list[int]]]:
    """The `most` best state sequences (list Viterbi), best first, ties by states."""
    lists: list[list[tuple[float, tuple[int, ...]]]] = [[(float(x), (i,))] if np.isfinite(x) else [] for i, x in enumerate(e[0])]
    for k, x in enumerate(m):
        new = []
        for j in range(x.shape[1]):
            found = [(s + float(x[i, j]) + float(e[k + 1][j]), (*p, j)) for i, own in enumerate(lists) for s, p in own if np.isfinite(x[i, j])]
            new.append(sorted(found, key=lambda f: (-f[0], f[1]))[:most])
        lists = new
    return [(s, list(p)) for s, p in sorted((f for own in lists for f in own), key=lambda f: (-f[0], f[1]))[:most]]


def trellis(at: np.ndarray, log_e: np.ndarray, between: np.ndarray, i: np.ndarray, j: np.ndarray, log_sum_: np.ndarray, log_max: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None], list[np.ndarray | None], list[np.ndarray | None]]:
    """k values, emissions, log sums, log maxima and best paths (None where no cell is) of one trip, from its states (k in `at`) and cells (k in `between`) in order of k."""
    ks = np.arange(int(at[0]), int(at[-1]) + 1)
    bounds = np.append(ks, ks[-1] + 1)
    cut = np.searchsorted(at, bounds).tolist()
    e = [log_e[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    cut = np.searchsorted(between, bounds).tolist()
    sums, tops, paths = [], [], []
    for n in range(len(ks) - 1):
        own = slice(cut[n], cut[n + 1])
        if cut[n] == cut[n + 1] or not len(e[n]) or not len(e[n + 1]):
            sums.append(None)
            tops.append(None)
            paths.append(None)
            continue
        shape = (len(e[n]), len(e[n + 1]))
        where = (i[own], j[own])
        s, t, p = np.full(shape, -np.inf), np.full(shape, -np.inf), np.full(shape, -1, np.int64)
        s[where], t[where], p[where] = log_sum_[own], log_max[own], best[own]
        sums.append(s)
        tops.append(t)
        paths.append(p)
    return ks, e, sums, tops, paths


def _by_trip(states: DataFrame, cells: DataFrame, run, out: str) -> DataFrame:
    """run(batch, trips) over many whole trips at once; trips gives the first row of each trip with states, and its trellis."""
    none = lambda kind: F.lit(None).cast(kind)
    own = states.select("trip_id", F.lit(0).alias("cell"), F.col("k").cast("long").alias("k"), F.col("i").cast("long").alias("i"), none("long").alias("j"), F.col("log_e").alias("x"), none("double").alias("y"), none("long").alias("path"))
    between = cells.select("trip_id", F.lit(1).alias("cell"), F.col("k").cast("long").alias("k"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("log_sum").alias("x"), F.col("log_max").alias("y"), F.col("best_path").alias("path"))
    # The window puts a trip's states first and tells where it begins. A fixed number of parts, as few bytes take long here and would be merged into few tasks.
    n = F.row_number().over(Window.partitionBy("trip_id").orderBy("cell", "k", "i", "j"))
    parts = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.unionByName(between).repartition(parts, "trip_id").withColumn("n", n)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(parts, 8):
            cell, k, i, j, x, y, path, place = (batch.column(c).fill_null(0).to_numpy() if pa.types.is_integer(batch.column(c).type) else batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 9))
            starts = np.flatnonzero(place == 1)
            ends = np.append(starts[1:], len(place))
            # Rows of states before each row.
            known = np.append(0, np.cumsum(cell == 0))
            middle = starts + known[ends] - known[starts]

            def trips() -> Iterator[tuple]:
                for a, b, c in zip(starts.tolist(), middle.tolist(), ends.tolist(), strict=True):
                    if b > a:
                        yield a, trellis(k[a:b], x[a:b], k[b:c], i[b:c], j[b:c], x[b:c], y[b:c], path[b:c])

            yield run(batch, trips())

    return rows.mapInArrow(batches, out)


def infer(states: DataFrame, cells: DataFrame, trip: str = "trip_id") -> DataFrame:
    """A row (OUT) for each state of each segment. states: trip_id, k, i, log_e. cells: trip_id, k, i, j, log_sum, log_max, best_path.

    Segments are stretches of the max-product pass; alpha, beta, log_z and prob are of the
    segment, mle marks the best state and mle_path the best path from it; cliff tells that the
    segment follows one that broke where paths exist.
    """

    def run(batch: pa.RecordBatch, trips: Iterator[tuple]) -> pa.RecordBatch:
        # Of each segment and observation, and of each state.
        by_seg, by_k, sizes, log_z, states_ = [], [], [], [], []
        for row, (ks, e, sums, tops, paths) in trips:
            for seg, (first, best) in enumerate(best_sequences(e, tops)):
                last = first + len(best) - 1
                alpha, beta, z = forward_backward(e[first : last + 1], [sums[k] for k in range(first, last)])
                cliff = first > 0 and tops[first - 1] is not None and seg > 0
                by_seg.append((row, seg, len(best), cliff))
                log_z.append(z)
                for n, k in enumerate(range(first, last + 1)):
                    by_k.append((ks[k], best[n], paths[k][best[n], best[n + 1]] if k < last else 0, k < last))
                    sizes.append(len(e[k]))
                states_.append((np.concatenate(e[first : last + 1]), np.concatenate(alpha), np.concatenate(beta)))
        row, seg, n, cliff = (np.array(x, np.int64) for x in (zip(*by_seg, strict=True) if by_seg else [[]] * 4))
        k, best, path, onward = (np.array(x, np.int64) for x in (zip(*by_k, strict=True) if by_k else [[]] * 4))
        log_e, alpha, beta = (np.concatenate(x) for x in (zip(*states_, strict=True) if states_ else [[np.zeros(0)]] * 3))
        size = np.array(sizes, np.int64)
        of_k = np.repeat(np.arange(len(size)), size)
        of_seg = np.repeat(np.arange(len(n)), n)[of_k]
        i = np.arange(len(of_k)) - np.repeat(np.cumsum(size) - size, size)
        z = np.array(log_z, float)[of_seg]
        with np.errstate(invalid="ignore", over="ignore"):
            prob = np.where(np.isfinite(z), np.exp(alpha + beta - z), np.nan)
        mle = i == best[of_k]
        columns = [
            batch.column(0).take(pa.array(row[of_seg])), pa.array(seg[of_seg].astype(np.int32)), pa.array(k[of_k]), pa.array(i.astype(np.int32)), pa.array(log_e), pa.array(alpha), pa.array(beta), pa.array(z), pa.array(prob),
            pa.array(mle), pa.array(path[of_k], mask=~(mle & (onward[of_k] == 1))), pa.array(cliff[of_seg] == 1),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return _by_trip(states, cells, run, OUT)


def path_marginals(inferred: DataFrame, cells: DataFrame) -> DataFrame:
    """trip_id, seg, k, path_id, prob of each path within a segment, from per-path cells (trip_id, k, i, j, path_id, log_p)."""
    a = inferred.select("trip_id", "seg", "k", "i", "alpha", "log_z")
    b = inferred.select("trip_id", "seg", (F.col("k") - 1).alias("k"), F.col("i").alias("j"), (F.col("log_e") + F.col("beta")).alias("__b"))
    # Merged, as a table that shuffles into few bytes can be large once it is broadcast.
    rows = cells.join(a.hint("merge"), ["trip_id", "k", "i"]).join(b.hint("merge"), ["trip_id", "seg", "k", "j"])
    return rows.groupBy("trip_id", "seg", "k", "path_id").agg(F.sum(F.exp(F.col("alpha") + F.col("log_p") + F.col("__b") - F.col("log_z"))).alias("prob"))


def top_k(states: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """trip_id, place, score, states: the best sequences over all of a trip's trellis (which must not break)."""

    def run(batch: pa.RecordBatch, trips: Iterator[tuple]) -> pa.RecordBatch:
        rows = []
        for row, (_, e, _, tops, _) in trips:
            if all(t is not None for t in tops):
                rows += [(row, n + 1, s, ",".join(map(str, p))) for n, (s, p) in enumerate(top_sequences(e, tops, most))]
        row, place, score, found = zip(*rows, strict=True) if rows else [()] * 4
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int64()), pa.array(score, pa.float64()), pa.array(found, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["trip_id", "place", "score", "states"])

    return _by_trip(states, cells, run, "trip_id long, place long, score double, states string")
