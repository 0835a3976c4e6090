"""Most frequent values of columns, exactly, without exchanging long values.

Cells are counted by a prefix and, where they are longer than that, a 128-bit hash: short values
travel as they are, long ones as a few bytes, both combined in each task first.  The prefix ranks
equal counts by value; where too many values agree in count and prefix, it is lengthened for that
column.  Long texts are read back for the winners alone.

With propose=True sketches of every column's frequent values come first, and one more scan counts
what they propose.  A column is settled where the candidates cover all its cells, or where even the
last of its top values is more frequent than anything the sketch may have missed; then no row of it
is exchanged at all.  That pays where scans are cheap against shuffles (many different values, none
of them long); otherwise reading a table once more costs more than exchanging its hashes.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import pin, small_frame, text_cells

TRACKED = 1000             # values a sketch follows in a column
#: Share of a column's cells that a value the sketch misses may have at most: the sketch's error is
#: 3.5 / its table's size (a power of two with room for TRACKED), and reported values are those
#: whose least possible count exceeds that error, so none above twice the error is missed.
MISSED = 2 * 3.5 / 2048
PREFIX = 32                # characters that rank values of equal count
MOST = 1000                # candidates of a column whose texts are read back

KEY = ["column", "h1", "h2"]


def _hashes(width: int) -> list:
    """The two hashes of a value as long as width or longer; null for others."""
    v = F.col("value")
    return [F.when(F.length(v) >= width, h).alias(n) for n, h in (
        ("h1", F.xxhash64(v)), ("h2", F.xxhash64(F.lit(1), v)))]


def hashed(cells: DataFrame, width: int, *keep: str) -> DataFrame:
    """(column, h1, h2, prefix and what is to be kept) of every cell that is not null."""
    return cells.where(F.col("value").isNotNull()).select(
        "column", *keep, *_hashes(width), F.left("value", F.lit(width)).alias("prefix"))


def _leaders(counts: DataFrame, k: int) -> DataFrame:
    """The rows of each column that may be among its k most frequent values, MOST + 1 at most:
    the k first by (count, prefix) and all that agree with the last of these."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "prefix")
    return counts.withColumn("place", F.rank().over(w)).withColumn(
        "line", F.row_number().over(w)).where(
        (F.col("place") <= k) & (F.col("line") <= MOST + 1)).drop("line")


def _proposed(cells: DataFrame, k: int) -> tuple[list, list[str]]:
    """Leaders of the columns that the sketches settle, and these columns' names."""
    items = hashed(cells, PREFIX).withColumn("item", F.xxhash64("h1", "prefix"))
    sketched = pin(items.groupBy("column").agg(
        F.count("*").alias("cells"),
        F.expr(f"approx_top_k(item, {TRACKED}, {TRACKED})").alias("top")).select(
        "column", "cells", F.col("top.item").alias("items")))
    candidates = sketched.select("column", F.explode("items").alias("item"))
    exact = items.join(F.broadcast(candidates), ["column", "item"]).groupBy(
        *KEY, "prefix").agg(F.count("*").alias("n"))
    covered = F.sum("n").over(Window.partitionBy("column"))  # TRACKED rows a column, about
    leaders = _leaders(exact.withColumn("covered", covered), k).collect()
    sizes = {r["column"]: r["cells"] for r in sketched.collect()}
    counts: dict[str, list[int]] = {}
    for r in leaders:
        counts.setdefault(r["column"], []).append(r["n"])
    covered = {r["column"]: r["covered"] for r in leaders}
    settled = [c for c, n in counts.items() if len(n) <= MOST and (
        covered[c] == sizes[c] or len(n) >= k and min(n) > MISSED * sizes[c])]
    return [r for r in leaders if r["column"] in settled], settled


def frequent_values(df: DataFrame, names: list[str], k: int, propose: bool = False) -> DataFrame:
    """column, rank, value, n: the k most frequent values of each named column as texts, the
    smaller value first among equal counts."""
    if not names:
        return _frame(df, []).withColumn("rank", F.col("n")).select("column", "rank", "value", "n")
    parts, left, width = [], names, PREFIX
    if propose:
        part, settled = _proposed(text_cells(df, names), k)
        parts.append((part, width))
        left = [n for n in names if n not in settled]
    while left:
        counts = hashed(text_cells(df, left), width).groupBy(*KEY, "prefix").agg(
            F.count("*").alias("n"))
        rows = _leaders(counts, k).collect()  # MOST + 1 short rows a column at most
        found = Counter(r["column"] for r in rows)
        left = [n for n in left if found[n] > MOST]
        parts.append(([r for r in rows if r["column"] not in left], width))
        width *= 8
    ranked = _frame(df, [(r["column"], r["prefix"], r["n"]) for rows, _ in parts for r in rows
                         if r["h1"] is None])
    for rows, width in parts:
        long = [(r["column"], r["h1"], r["h2"]) for r in rows if r["h1"] is not None]
        if long:
            ranked = ranked.unionByName(texts(df, long, width))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return ranked.withColumn("rank", F.row_number().over(w).cast("bigint")).where(
        F.col("rank") <= k).select("column", "rank", "value", "n")


def modes(df: DataFrame, names: list[str]) -> DataFrame:
    """column, mode, n: each named column's most frequent value, the smallest one on ties."""
    return frequent_values(df, names, 1).select("column", F.col("value").alias("mode"), "n")


def _frame(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return small_frame(df.sparkSession, rows, "column string, value string, n bigint")


def texts(df: DataFrame, long: list[tuple], width: int) -> DataFrame:
    """(column, value, n) of the values with the given (column, h1, h2).

    Values are grouping keys here, so that no task sorts the texts it has found.
    """
    wanted = small_frame(df.sparkSession, long, "column string, h1 bigint, h2 bigint")
    return text_cells(df, sorted({c for c, _, _ in long})).select(
        "column", "value", *_hashes(width)).join(F.broadcast(wanted), KEY).groupBy(
        "column", "value").agg(F.count("*").alias("n"))
