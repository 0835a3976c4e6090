"""Two-sample Kolmogorov-Smirnov statistics by branch and bound.

The statistic is the largest gap between two distribution functions.  Quantile sketches of both
samples give cut points; one scan counts the values at each cut and between neighbours.  The gap at
the cuts is then exact, and between two cuts it cannot exceed what the counts on either side allow.
Only intervals whose bound beats the best exact gap are looked into: cut again while they are
large and few, then counted value by value.  No step sorts the values of a whole column, and what is
exchanged are sketches, counts per interval, and the values of the intervals left at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import count_below, small_frame, sorted_numbers

CUTS = 511                 # cut points per sample, so at most 1022 an interval
ROUNDS = 3                 # of cutting before values are counted one by one
SMALL = 1_000_000          # rows of an interval that are counted so at once
OPEN = 50                  # intervals that are cut again in one round
BLOCK = 50                 # columns of one round


class Interval(NamedTuple):
    """An open interval of a column: rows of either sample at or below its start, and in it."""
    key: str
    column: str
    below_a: int
    below_b: int
    in_a: int
    in_b: int


def _cut_points(cells: DataFrame) -> dict[str, list[float]]:
    """Cut points of every key: quantiles of both samples, each value once."""
    at = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    rows = cells.groupBy("key", "side").agg(
        F.kll_sketch_agg_double("value", F.lit(1000)).alias("sketch")).select(
        "key", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, at))).alias("q")
    ).collect()
    cuts: dict[str, set[float]] = {}
    for r in rows:
        cuts.setdefault(r["key"], set()).update(r["q"] or [])
    return {key: sorted(q) for key, q in cuts.items()}


def _slots(cells: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """cells of the keys with cuts, with slot: 2i between the cuts i - 1 and i, 2i + 1 at cut i."""
    at = sorted_numbers(cuts, F.col("key"))
    i = F.col("i")
    return cells.where(F.col("key").isin(*cuts)).withColumn("i", count_below(
        at, F.col("value"), 2 * CUTS)).withColumn("slot", 2 * i + F.coalesce(
            F.get(at, i) == F.col("value"), F.lit(False)).cast("int")).drop("i")


def _counted(slots: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """(slot, rows of a, rows of b) of every key, in order."""
    side, out = F.col("side"), {}
    for r in slots.groupBy("key", "slot").agg(
            F.count_if(side == "a").alias("a"), F.count_if(side == "b").alias("b")).collect():
        out.setdefault(r["key"], []).append((r["slot"], r["a"], r["b"]))
    return {key: sorted(rows) for key, rows in out.items()}


def _gap(a: int, b: int, totals: tuple[int, int]) -> float:
    return abs(a / totals[0] - b / totals[1])


def _bound(x: Interval, totals: tuple[int, int]) -> float:
    """The largest gap there may be within x: one sample's values first, or the other's."""
    return max(_gap(x.below_a + x.in_a, x.below_b, totals),
               _gap(x.below_a, x.below_b + x.in_b, totals))


def _by_value(cells: DataFrame, left: list[Interval], totals: dict[str, tuple[int, int]],
              best: dict[str, float]) -> None:
    """The exact gaps within the intervals left: at most their values are exchanged."""
    frame = small_frame(cells.sparkSession, [(
        x.key, x.column, x.below_a, x.below_b, *totals[x.column]) for x in left],
        "key string, column string, below_a bigint, below_b bigint, all_a bigint, all_b bigint")
    side = F.col("side")
    upto = Window.partitionBy("key").orderBy("value")
    hist = cells.groupBy("key", "value").agg(
        F.count_if(side == "a").alias("a"), F.count_if(side == "b").alias("b"))
    gap = F.abs((F.col("below_a") + F.col("a")) / F.col("all_a")
                - (F.col("below_b") + F.col("b")) / F.col("all_b"))
    for r in hist.select("key", F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b")
                         ).join(F.broadcast(frame), "key").groupBy("column").agg(
            F.max(gap).alias("gap")).collect():
        best[r["column"]] = max(best[r["column"]], r["gap"])


def statistics(cells: DataFrame, names: list[str], least_rows: int) -> list[tuple]:
    """(column, n_a, n_b, statistic) of the named columns with enough rows in both samples.

    cells: (column, side, value), side 'a' or 'b', no nulls.
    """
    out = []
    for at in range(0, len(names), BLOCK):
        out += _block(cells.where(F.col("column").isin(names[at:at + BLOCK])), least_rows)
    return out


def _block(cells: DataFrame, least_rows: int) -> list[tuple]:
    totals: dict[str, tuple[int, int]] = {}
    best: dict[str, float] = {}
    cells = cells.withColumn("key", F.col("column")).select("key", "side", "value")
    todo: dict[str, Interval] = {}
    for step in range(ROUNDS):
        cuts = _cut_points(cells)
        if not cuts:
            break  # no values at all
        slots = _slots(cells, cuts)
        left = []
        for key, rows in _counted(slots).items():
            if step == 0:
                totals[key] = sum(r[1] for r in rows), sum(r[2] for r in rows)
                if min(totals[key]) < max(1, least_rows):
                    del totals[key]
                    continue
                best[key], todo[key] = 0.0, Interval(key, key, 0, 0, *totals[key])
            x = todo[key]
            a, b = x.below_a, x.below_b
            for slot, n_a, n_b in rows:
                if slot % 2 == 0:
                    left.append(Interval(f"{key}/{slot}", x.column, a, b, n_a, n_b))
                a, b = a + n_a, b + n_b
                # behind an interval as at a cut, the gap is exact: its last value is the place
                best[x.column] = max(best[x.column], _gap(a, b, totals[x.column]))
        left = [x for x in left if x.in_a + x.in_b > 1
                and _bound(x, totals[x.column]) > best[x.column]]
        if not left:
            break
        todo = {x.key: x for x in left}
        keys = small_frame(cells.sparkSession, [(x.key,) for x in left], "key string")
        cells = slots.withColumn("key", F.concat_ws("/", "key", "slot")).join(
            F.broadcast(keys), "key", "left_semi").select("key", "side", "value")
        large = max(x.in_a + x.in_b for x in left) > SMALL
        if not large or len(left) > OPEN or step == ROUNDS - 1:
            _by_value(cells, left, totals, best)
            break
    return [(column, *totals[column], best[column]) for column in sorted(totals)]
