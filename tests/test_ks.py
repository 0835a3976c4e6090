"""Branch-and-bound KS statistics against counting every value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ks


def reference(a, b):
    values = np.union1d(a, b)
    return float(np.abs(np.searchsorted(np.sort(a), values, "right") / len(a)
                        - np.searchsorted(np.sort(b), values, "right") / len(b)).max())


def samples():
    rng = np.random.default_rng(3)
    n = rng.normal(0, 1, 3000)
    return {
        "shifted": (n, rng.normal(0.4, 1, 2000)),
        "same law": (n, rng.normal(0, 1, 3000)),
        "equal": (n, n[::-1]),
        "few values": (rng.integers(0, 4, 2000) * 1.0, rng.integers(0, 5, 1500) * 1.0),
        "constant": (np.full(100, 7.0), np.full(90, 7.0)),
        "apart": (np.full(100, -1.0), np.full(90, 1.0)),
        "wide": (np.exp(rng.normal(0, 80, 3000)), -np.exp(rng.normal(1, 80, 2500))),
        "infinite": (np.r_[n, [np.inf] * 300], np.r_[-np.inf, n, 5.0]),
        "hot": (np.r_[np.zeros(3000), n], np.r_[np.zeros(1000), n + 0.001]),
    }


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(name, side, float(v)) for name, pair in samples().items()
            for side, x in zip("ab", pair, strict=True) for v in x]
    return spark.createDataFrame(rows, "column string, side string, value double").repartition(5)


@pytest.mark.parametrize("small, open_, rounds", [(10 ** 6, 50, 3), (5, 10 ** 6, 3), (5, 3, 2)])
def test_statistics_are_exact(cells, monkeypatch, small, open_, rounds):
    for name, value in (("SMALL", small), ("OPEN", open_), ("ROUNDS", rounds), ("CUTS", 20)):
        monkeypatch.setattr(ks, name, value)
    got = {r[0]: r for r in ks.statistics(cells, list(samples()), 2)}
    for name, (a, b) in samples().items():
        assert got[name][1:3] == (len(a), len(b))
        assert got[name][3] == reference(a, b), name


def test_too_few_rows_are_left_out(cells):
    few = cells.where((F.col("side") == "a") | (F.col("column") == "equal"))
    assert [r[0] for r in ks.statistics(few, list(samples()), 2)] == ["equal"]
    assert ks.statistics(cells.limit(0), ["equal"], 2) == []


def test_most_intervals_are_never_opened(spark, monkeypatch):
    """Only values near the largest gap are counted one by one: u against its square, at 1/4."""
    u = (F.floor(F.col("id") / 2) + 0.5) / 100_000
    df = spark.range(200_000).select(
        F.lit("x").alias("column"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("side"),
        F.when(F.col("id") % 2 == 0, u).otherwise(u * u).alias("value"))
    seen = []
    exact = ks._by_value

    def by_value(cells, left, totals, best):
        seen.append(sum(x.in_a + x.in_b for x in left))
        exact(cells, left, totals, best)
    monkeypatch.setattr(ks, "_by_value", by_value)
    (_, n_a, n_b, gap), = ks.statistics(df, ["x"], 2)
    assert (n_a, n_b) == (100_000, 100_000) and abs(gap - 0.25) < 1e-4
    assert sum(seen) < 40_000
