"""The isolation forest where values repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import isolation


def test_repeated_values_keep_their_weight(spark):
    """40,000 rows: a third one value, 100 others alike, one value in 20 rows far away."""
    df = spark.range(40_000).select(F.when(F.col("id") < 20, 1000.0).when(
        F.col("id") % 3 == 0, 50.0).otherwise((F.col("id") % 101).cast("double")).alias("x"))
    counts = spark.createDataFrame([("x", 40_000)], "column string, n bigint")
    held = {r["value"]: r["weight"] for r in isolation._weighted(
        df, ["x"], counts, isolation.GRID).collect()}
    assert abs(sum(held.values()) - isolation.GRID) < 100
    assert abs(held[50.0] / isolation.GRID - 1 / 3) < 0.02 and len(held) == 102
    ranges = isolation.flagged_ranges(df).first()["ranges"]
    assert any(r["lo"] < 1000.0 <= r["hi"] for r in ranges)
    assert not any(r["lo"] < 50.0 <= r["hi"] for r in ranges)


def test_few_values_in_many_rows(spark):
    df = spark.range(2_000_000).select((F.col("id") % 100).cast("double").alias("x"))
    counts = spark.createDataFrame([("x", 2_000_000)], "column string, n bigint")
    held = isolation._weighted(df, ["x"], counts, isolation.GRID).collect()
    assert [r["weight"] for r in held] == [80] * 100
    assert isolation.flagged_ranges(df).count() == 1


def test_share_is_exact_over_many_distinct_values(spark):
    """1,000,000 different values: the flagged share is the wanted one, counted over all rows."""
    df = spark.range(1_000_000).select(F.randn(3).alias("x"), F.exp(F.randn(5)).alias("y"))
    ranges = isolation.flagged_ranges(df)
    cells = df.unpivot([], ["x", "y"], "column", "v").join(F.broadcast(ranges), "column")
    for r in cells.groupBy("column").agg(F.avg(isolation.in_ranges(
            F.col("v"), F.col("ranges")).cast("double")).alias("share")).collect():
        assert 0.0495 < r["share"] <= 0.05


def test_quantile_of_counted_values():
    rng = np.random.default_rng(1)
    values, counts = rng.permutation(50) / 7, rng.integers(0, 9, 50)
    for share in (0.0, 0.05, 0.31, 1.0):
        assert isolation.lower_quantile(values, counts, share) == pytest.approx(
            np.quantile(np.repeat(values, counts), share))
