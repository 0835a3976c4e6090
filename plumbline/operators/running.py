"""Ordered computations over groups of any size, spread over many tasks.

A window over a whole group puts the group into one task.  Here rows are range-partitioned
on (group, order), each (group, range) is one window group, and neighbouring ranges are
stitched together by one small row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.session import checkpointed


ROWS = 4_000_000  # of a range, about


def _ranged(df: DataFrame, key: str, order: str, ranges: int | None) -> DataFrame:
    """df with its range number, stored in the shared folder; the number of ranges grows with the
    rows unless it is given.

    Range bounds are sampled, and a second evaluation could draw other ones; the reliable
    checkpoint fixes them.
    """
    if ranges is None:
        df = checkpointed(df)  # counted, sampled and dealt out below, but computed once
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                     -(-df.count() // ROWS))
    return checkpointed(df.repartitionByRange(ranges, key, order)
                        .withColumn("range", F.spark_partition_id()))


def cumulative(hist: DataFrame, counts: list[str], ranges: int | None = None) -> DataFrame:
    """hist(column, value DOUBLE, counts...) plus cum_<count>: running sum up to value.

    hist holds each (column, value) once, so no range can be dominated by a hot value.
    """
    ranged = _ranged(hist, "column", "value", ranges)
    totals = ranged.groupBy("column", "range").agg(*[F.sum(c).alias(f"t_{c}") for c in counts])
    before = Window.partitionBy("column").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)  # at most `ranges` rows per column
    offsets = totals.select("column", "range", *[
        F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in counts])
    upto = Window.partitionBy("column", "range").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)
    running = ranged.select("*", *[F.sum(c).over(upto).alias(f"s_{c}") for c in counts])
    # ranges are contiguous: at most columns + ranges rows, so broadcasting is always safe
    return running.join(F.broadcast(offsets), ["column", "range"]).select(
        "column", "value", *counts,
        *[(F.col(f"s_{c}") + F.col(f"o_{c}")).alias(f"cum_{c}") for c in counts])


def with_previous(df: DataFrame, key: str, order: str, columns: list[str],
                  ranges: int | None = None) -> DataFrame:
    """df plus prev_<column> from the row before it in its key's order (null for the first).

    (key, order) must be unique.  A key may hold any share of the rows: it then spans many
    ranges, and only such keys take part in the stitching.
    """
    ranged = _ranged(df, key, order, ranges)
    w = Window.partitionBy(key, "range").orderBy(order)
    inside = ranged.select("*", F.lag(F.struct(*columns)).over(w).alias("_before"))
    last = ranged.groupBy(key, "range").agg(
        F.max_by(F.struct(*columns), F.col(order)).alias("_last"))
    spanning = last.groupBy(key).agg(F.count("*").alias("_spans")).where("_spans > 1")
    # a key spanning k ranges adds k rows, so there are at most twice as many rows as ranges
    edges = last.join(F.broadcast(spanning.select(key)), key).select(
        key, "range", F.lag("_last").over(Window.partitionBy(key).orderBy("range"))
        .alias("_carried"))
    before = F.coalesce("_before", "_carried")
    return inside.join(F.broadcast(edges), [key, "range"], "left").select(
        *df.columns, *[before[c].alias(f"prev_{c}") for c in columns])
