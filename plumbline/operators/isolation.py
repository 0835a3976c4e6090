"""Isolation forest per numeric column.

On one dimension a forest is a step function of the value.  Trees are grown from the
column's values, weighted by their counts and thinned by value hash, therefore the same however
the table is partitioned, one small task per (column, tree).  The rows of every step of the summed
forest are counted, which tells the flagged ranges of values; the table is then filtered by them.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators.cells import (
    count_below, histogram, names_of, number_cells, pin, small_frame, sorted_numbers)

# ship the worker functions by value: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, SAMPLE, SEED = 100, 256, 42
GRID = 8_000  # points that the trees are grown from
BLOCK = 20    # columns whose steps are counted in one scan


def _expected_depth(n: int) -> float:
    """Average search depth of an unbuilt subtree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _leaves(points: np.ndarray, lo: float, hi: float, depth: int, limit: int, rng) -> list:
    """(lo, hi, path length) of every leaf of one random tree over sorted points."""
    if len(points) <= 1 or depth >= limit or points[0] == points[-1]:
        return [(lo, hi, depth + _expected_depth(len(points)))]
    cut = rng.uniform(points[0], points[-1])
    k = int(np.searchsorted(points, cut, side="right"))
    if k == len(points):
        return [(lo, hi, depth + _expected_depth(len(points)))]
    return (_leaves(points[:k], lo, cut, depth + 1, limit, rng)
            + _leaves(points[k:], cut, hi, depth + 1, limit, rng))


def _grid(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sampled values of a column in order, and how often each occurs."""
    return (np.asarray(pdf["grid"].iloc[0], dtype=float),
            np.asarray(pdf["weight"].iloc[0], dtype=np.int64))


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Leaves of one (column, tree) as depth changes at the left edge of each leaf."""
    column, tree = pdf["column"].iloc[0], int(pdf["tree"].iloc[0])
    grid, weight = _grid(pdf)
    n = int(pdf["n"].iloc[0])
    rng = np.random.default_rng([SEED, tree, *column.encode()])
    size = min(SAMPLE, n)
    points = np.sort(rng.choice(np.repeat(grid, weight), size=size,
                                replace=size > weight.sum()))
    limit = math.ceil(math.log2(max(size, 2)))
    leaves = _leaves(points, -math.inf, math.inf, 0, limit, rng)
    depths = np.array([d for _, _, d in leaves])
    return pd.DataFrame({"column": column, "edge": [lo for lo, _, _ in leaves],
                         "step": np.diff(depths, prepend=0.0)})


def _steps(edges: pd.DataFrame) -> pd.DataFrame:
    """The forest of one column as a step function: mean path length from each edge on.  Input
    is bounded: at most trees x sample edges."""
    summed = edges.groupby("edge")["step"].sum().sort_index()
    return pd.DataFrame({"column": [edges["column"].iloc[0]], "edges": [summed.index.to_numpy()],
                         "depths": [np.cumsum(summed.to_numpy()) / TREES]})


def lower_quantile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """The quantile of values occurring so often, interpolated between order statistics."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    rank = (upto[-1] - 1) * share
    low, high = (values[order[np.searchsorted(upto, np.floor(rank) + k, side="right")]]
                 for k in (0, min(1, math.ceil(rank) - math.floor(rank))))
    return low + (rank - np.floor(rank)) * (high - low)


def _cut(edge: np.ndarray, depth: np.ndarray, counts: np.ndarray, share: float) -> list[tuple]:
    """Ranges (lo, hi] whose mean path length lies below the share's quantile over all rows."""
    flagged = depth < lower_quantile(depth, counts, share)
    starts = flagged & ~np.concatenate([[False], flagged[:-1]])
    ends = flagged & ~np.concatenate([flagged[1:], [False]])
    upper = np.append(edge[1:], math.inf)
    return list(zip(edge[starts].tolist(), upper[ends].tolist(), strict=True))


def _weighted(df: DataFrame, names: list[str], counts: DataFrame, grid: int) -> DataFrame:
    """(column, value, weight): each value's share of about `grid` points, rounded up or down by
    the value's hash, so that copies keep their weight; all rows where there are not many more."""
    share = F.when(F.col("n") > 2 * grid, grid / F.col("n")).otherwise(1.0)
    part = F.pmod(F.xxhash64(F.lit(SEED), "column", "value"), F.lit(1 << 30)) / (1 << 30)
    return histogram(number_cells(df, names)).withColumnRenamed("n", "held").join(
        F.broadcast(counts), "column").select(
        "column", "value", F.floor(F.col("held") * share + part).alias("weight")).where(
        "weight > 0")


def flagged_ranges(df: DataFrame, names: list[str] | None = None,
                   contamination: float = vocab.FOREST_CONTAMINATION,
                   min_rows: int = 2, grid: int = GRID) -> DataFrame:
    """column, ranges ARRAY<STRUCT<lo, hi>>: value ranges (lo, hi] counted as outliers.

    Values are flagged when their mean path length is below the contamination quantile over all
    rows of the table: the forest's steps are counted in one scan, so the share is exact.  Another
    scan is grouped by value for the trees; everything else has a fixed size per column.
    """
    names = names if names is not None else names_of(df, "numeric")
    counts = number_cells(df, names).groupBy("column").agg(F.count("value").alias("n")).where(
        F.col("n") >= min_rows)
    counts = pin(counts)
    held = _weighted(df, names, counts, grid)
    grids = pin(held.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("value", "weight"))).alias("held")).join(
        F.broadcast(counts), "column").select(
        "column", F.col("held.value").alias("grid"), F.col("held.weight").alias("weight"), "n"))
    # a fixed number of partitions: the rows are few but each one is a tree to grow, so
    # they must not be coalesced by size
    grown = (grids.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(TREES))))
             .repartition(max(8, min(len(names) * 8, 200)), "column", "tree")
             .groupBy("column", "tree")
             .applyInPandas(_grow, "column string, edge double, step double"))
    steps = {r["column"]: (np.array(r["edges"]), np.array(r["depths"])) for r in
             grown.groupBy("column").applyInPandas(
                 _steps, "column string, edges array<double>, depths array<double>").collect()}
    out = []
    for at in range(0, len(names), BLOCK):
        part = {n: steps[n] for n in names[at:at + BLOCK] if n in steps}
        if not part:
            continue
        most = max(len(edge) for edge, _ in part.values())
        edges = sorted_numbers({n: edge.tolist() for n, (edge, _) in part.items()}, F.col("column"))
        found = number_cells(df, list(part)).where(F.col("value").isNotNull()).select(
            "column", count_below(edges, F.col("value"), most).alias("at")).groupBy(
            "column", "at").agg(F.count("*").alias("n")).collect()  # a row per step at most
        for n, (edge, depth) in part.items():
            held_by = np.zeros(len(edge), np.int64)
            for r in found:
                if r["column"] == n:
                    held_by[max(r["at"], 1) - 1] += r["n"]
            out += [(n, lo, hi) for lo, hi in _cut(edge, depth, held_by, contamination)]
    ranges = small_frame(df.sparkSession, out, "column string, lo double, hi double")
    return ranges.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def in_ranges(value, ranges):
    """Condition: value lies in one of the (lo, hi] ranges."""
    return F.exists(ranges, lambda r: (value > r["lo"]) & (value <= r["hi"]))
