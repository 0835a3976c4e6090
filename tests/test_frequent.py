"""Most frequent values against counting everything."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import frequent


def reference(rows, names, k):
    out = []
    for i, name in enumerate(names):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
        out += [(name, rank, v, n) for rank, (v, n) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    long = "shared beginning of every text, longer than any prefix " * 8
    out = []
    for i in range(4000):
        out.append((rng.choice("abc"), f"unique {i:05d}", f"{long}{i % 2000}",
                    None if i % 3 else f"{'x' * 40}{rng.randint(0, 5)}",
                    "hot " * 20 if i % 3 == 0 else f"{i}{'y' * 50}", None))
    return out


NAMES = ["few", "unique", "tied_long", "gaps", "hot", "empty"]


@pytest.mark.parametrize("propose", [False, True])
@pytest.mark.parametrize("k", [1, 10])
def test_frequent_values(spark, rows, k, propose):
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in NAMES)).repartition(7)
    got = frequent.frequent_values(df, NAMES, k, propose)
    assert got.columns == ["column", "rank", "value", "n"]
    assert sorted(tuple(r) for r in got.collect()) == reference(rows, NAMES, k)


def test_proposals_settle_hot_columns(spark):
    rows = [("a" if i % 2 else f"rare {i}",) for i in range(20_000)]
    df = spark.createDataFrame(rows, "v string")
    leaders, settled = frequent._proposed(frequent.text_cells(df, ["v"]), 1)
    assert settled == ["v"] and [(r["prefix"], r["n"]) for r in leaders] == [("a", 10_000)]
    assert frequent._proposed(frequent.text_cells(df, ["v"]), 2)[1] == []  # the rest is flat


def test_nothing(spark):
    df = spark.createDataFrame([], "v string")
    assert frequent.frequent_values(df, ["v"], 3).count() == 0
    assert frequent.frequent_values(df, [], 3).count() == 0
    assert frequent.modes(df, ["v"]).columns == ["column", "mode", "n"]


def test_no_exchange_carries_a_long_text(spark, sf):
    """The counts are exchanged as hashes and prefixes; only winners' texts travel."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    counts = frequent.hashed(frequent.text_cells(df, ["text"]), frequent.PREFIX).groupBy(
        "column", "h1", "h2", "prefix").agg(F.count("*").alias("n"))
    plan = frequent._leaders(counts, 10)._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "partial_count" in line]
    assert partial and all("value" not in line.split("functions=")[0] for line in partial)
    assert df.select(F.max(F.length("text"))).first()[0] > 10 * frequent.PREFIX
