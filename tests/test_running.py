"""Ranges of ordered computations grow with the rows."""

from itertools import accumulate

import pytest

from plumbline.operators import running


@pytest.mark.parametrize("rows", [40, 1_000_000])
def test_results_in_any_number_of_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(running, "ROWS", rows)
    data = [("hot", float(i), i % 7) for i in range(900)] + [("x", 1.0, 2), ("x", 2.0, 3)]
    df = spark.createDataFrame(data, "column string, value double, n bigint").repartition(3)
    got = {(r["column"], r["value"]): r["cum_n"] for r in running.cumulative(df, ["n"]).collect()}
    sums = list(accumulate(n for c, _, n in data if c == "hot"))
    assert got == {("hot", float(i)): s for i, s in enumerate(sums)} | {
        ("x", 1.0): 2, ("x", 2.0): 5}
    before = {(r["column"], r["value"]): r["prev_n"]
              for r in running.with_previous(df, "column", "value", ["n"]).collect()}
    assert before == {("hot", float(i)): (i - 1) % 7 if i else None for i in range(900)} | {
        ("x", 1.0): None, ("x", 2.0): 2}
    ranges = running._ranged(df, "column", "value", None).select("range").distinct().count()
    assert ranges > 8 if rows == 40 else ranges <= int(
        spark.conf.get("spark.sql.shuffle.partitions"))
