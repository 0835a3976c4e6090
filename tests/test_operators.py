"""Operators on small frames with results worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import (
    anomalies, changes, cleaning, drift, facts, forecast, frequent, isolation, pii, profile, repair,
    report, root_cause, score, security, versions)
from plumbline.operators.cells import histogram, number_cells, pin
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.running import cumulative
from plumbline.plans import fixtures
from plumbline.sources import delimiters, readers, writers

CFG = score.ScoreConfig(method="iqr", as_of=dt.date(2025, 1, 1))


def frame(spark, name, rows, dtype="string"):
    return spark.createDataFrame([(x,) for x in rows], f"`{name}` {dtype}")


# ------------------------------------------------------------------ exact distributed pieces
@pytest.mark.parametrize("limit", [10, 200, 10 ** 6])
def test_quantiles_equal_numpy_with_hot_values(spark, limit):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(2, 2, 4000), np.full(2500, 7.25), np.full(900, -3.0)])
    y = np.where(np.arange(len(x)) % 3 == 0, 1.0, rng.normal(size=len(x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(6)
    probs = (0.01, 0.25, 0.5, 0.75, 0.999)
    got = {r["column"]: r for r in exact_quantiles(df, ["x", "y"], probs, limit).collect()}
    for name, v in (("x", x), ("y", y)):
        assert got[name]["n"] == len(v)
        np.testing.assert_allclose(list(got[name])[2:], np.quantile(v, probs), rtol=1e-12)


def test_quantiles_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b"]).collect()}
    assert "a" not in got and got["b"]["q_50"] == 1.0


@pytest.mark.parametrize("ranges", [4, 64])
def test_cumulative_counts(spark, ranges):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=3000), 2)
    v[:1200] = 0.5
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    hist = histogram(number_cells(df, ["v"]))
    got = cumulative(hist, ["n"], ranges).orderBy("value").toPandas()
    want = pd.Series(v).value_counts().sort_index()
    np.testing.assert_array_equal(got["n"], want.to_numpy())
    np.testing.assert_array_equal(got["cum_n"], want.cumsum().to_numpy())


def test_pin_refuses_large_results(spark):
    with pytest.raises(ValueError):
        pin(spark.range(20), 10)


# ------------------------------------------------------------------ profile
def test_mode_takes_smallest_on_ties(spark):
    df = frame(spark, "c", ["a", "a", "b", "b", None])
    assert frequent.modes(df, df.columns).first()["mode"] == "a"


def test_duplicates_exact_and_logical(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, "x", None), (3, "y", 1)],
                               "id int, a string, b int")
    r = profile.duplicates(df).first()
    assert (r["exact_dups"], r["logical_dups"], r["id_columns"]) == (1, 2, ["id"])
    only_id = profile.duplicates(df.select("id")).first()
    assert only_id["exact_dups"] == only_id["logical_dups"] == 1


def test_profile_of_constant_column(spark):
    r = profile.numeric_stats(frame(spark, "v", [2.0] * 5, "double")).first()
    assert r["skewness"] == 0.0 and r["kurtosis"] == 0.0


def test_first_samples_by_stored_row_position(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).withColumn("v", F.concat(F.lit("r"), "id")).drop("id").coalesce(1) \
        .write.parquet(path)
    df = readers.read_parquet(spark, path, row_id=True)
    got = profile.sample_values(df, ["_row_file", "_row_index"]).orderBy("rank").collect()
    assert [r["value"] for r in got] == ["r0", "r1", "r2", "r3", "r4"]
    assert profile.null_rows(df).first()["rows"] == 50


# ------------------------------------------------------------------ anomalies
def test_iqr_fence(spark):
    df = frame(spark, "v", [float(x) for x in list(range(1, 11)) + [100]], "double")
    got = anomalies.numeric_flags(df, "iqr").collect()
    assert [(r["value"], r["method"]) for r in got] == [("100.0", "iqr")]


def test_zscore_of_constant_column(spark):
    df = frame(spark, "v", [4.0] * 30, "double")
    assert anomalies.numeric_flags(df, "zscore").count() == 0


def test_too_few_observations(spark):
    df = frame(spark, "v", [1.0, 2.0, 1000.0], "double")
    assert anomalies.numeric_flags(df, "iqr").count() == 0


def test_rarity(spark):
    df = frame(spark, "status", ["Active"] * 200 + ["actve"])
    assert [r["value"] for r in anomalies.rare_values(df, []).collect()] == ["actve"]


def test_age_rule_suppresses_statistics(spark):
    df = frame(spark, "age", [30] * 30 + [150, 14, 16], "long")
    got = anomalies.detect(df, "iqr").first()
    assert got["methods_used"] == ["impossible_age"] and got["severity"] == "high"
    assert got["distinct_values"] == 2


def test_ids_are_skipped(spark):
    df = frame(spark, "id", list(range(30)) + [10 ** 9], "long")
    assert anomalies.detect(df, "iqr").count() == 0


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        anomalies.flagged(frame(spark, "v", [1.0], "double"), "magic")


def test_isolation_forest_flags_extremes(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=2000), [60.0, -55.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = anomalies.numeric_flags(df, "isolation_forest").toPandas()
    flagged = got["value"].astype(float)
    assert {60.0, -55.0} <= set(flagged)
    assert 0.02 < got["n"].sum() / len(v) < 0.08


def test_isolation_forest_ignores_partitioning(spark):
    df = spark.range(60_000).select(F.col("id").alias("n"), (F.randn(3) * 10).alias("x"))
    df = spark.createDataFrame(df.toPandas())
    got = [{(r["value"], r["n"]) for r in anomalies.numeric_flags(
        df.repartition(parts), "isolation_forest").collect()} for parts in (1, 3, 16)]
    assert got[0] and got[0] == got[1] == got[2]


# ------------------------------------------------------------------ security and PII
def test_threats(spark):
    rows = ["<script>alert(1)</script>", "x; DROP TABLE t", "../../etc/passwd", "a; cat f",
            "nul\x00", "plain", None]
    df = frame(spark, "c", rows).withColumn("k", F.monotonically_increasing_id())
    found = security.findings(df, ["k"])
    kinds = {r["threat_type"] for r in found.collect()}
    assert kinds == {"xss", "sql_injection", "path_traversal", "command_injection", "null_byte"}
    v = security.verdict(security.threat_counts(df.drop("k"))).first()
    assert v["total_threats"] == found.count() and v["has_critical"]
    assert v["score_deduction"] == 25 + 25 + 15 + 20 + 10


def test_only_shown_findings_are_shortened(spark):
    df = frame(spark, "c", ["<script>" + "x" * 500 + "</script>"]).withColumn("k", F.lit(1))
    found = security.findings(df, ["k"])
    assert len(found.first()["value"]) == 517
    r = security.display(found, ["k"]).first()
    assert len(r["value"]) == 200 and len(r["matched_pattern"]) == 80


def test_clean_table_has_no_threats(spark):
    v = security.verdict(security.threat_counts(frame(spark, "c", ["ok"]))).first()
    assert (v["total_threats"], v["has_critical"], v["score_deduction"]) == (0, False, 0)


def test_pii_confidence(spark):
    df = spark.createDataFrame(
        [("a@b.com", "10.0.0.1 up")] * 4 + [("x", "down")] * 6, "email string, log string")
    got = {r["column"]: (r["pii_type"], r["confidence"])
           for r in pii.columns(pii.match_counts(df)).collect()}
    assert got == {"email": ("email", "high"), "log": ("ipv4", "medium")}


def test_pii_needs_a_valid_card_number(spark):
    df = frame(spark, "c", ["4111 1111 1111 1112 0"])
    kinds = {r["pii_type"] for r in pii.match_counts(df).collect()}
    assert "credit_card" not in kinds


# ------------------------------------------------------------------ score
def _points(spark, **dims):
    rows = [(d, "r", "low", float(v), []) for d, v in dims.items()]
    return score.dimension_points(spark.createDataFrame(
        rows, "dimension string, reason string, impact string, deduction double, "
              "affected_columns array<string>"))


@pytest.mark.parametrize("total,threat,expected", [
    (3.0, False, 95.0), (12.0, False, 88.0), (20.0, False, 80.0), (0.0, True, 30.0),
    (80.0, False, 20.0), (130.0, False, 0.0)])
def test_score_caps(spark, total, threat, expected):
    got = spark.range(1).select(score.final_score(
        F.lit(total), F.lit(0), F.lit(threat), F.lit(0.0), F.lit(0), F.lit(0))).first()[0]
    assert got == expected


def test_compounding(spark):
    p = _points(spark, completeness=5, validity=40, consistency=4, garbage=9)
    r = score.compounding(p).first()
    assert (r["failing"], r["deduction"]) == (4, 10.0)
    got = {x["dimension"]: x["deducted"] for x in p.collect()}
    assert got["validity"] == 35.0 and got["uniqueness"] == 0.0


def test_formula_constants(spark):
    r = spark.range(1).select(score._power(F.lit(10.0), 0.35, 35.0),
                              score._power(F.lit(10.0), 0.6, 15.0),
                              score._power(F.lit(5.0), 1.5, 12.0)).first()
    assert [round(x, 3) for x in r] == [5.547, 9.509, 10.348]


def test_valid_dates_cost_nothing(spark):
    df = spark.createDataFrame([(f"2023-01-0{i}",) for i in range(1, 6)], "date string")
    assert score.score(df, CFG).penalties.where("dimension = 'validity'").count() == 0


def test_future_dates(spark):
    rows = [("2030-01-01", "2030-01-01")] * 6
    df = spark.createDataFrame(rows, "order_date string, end_date string")
    t = {r["column"]: r for r in facts.text_facts(df, dt.date(2029, 6, 1)).collect()}
    assert t["order_date"]["date_future"] == 6 and t["end_date"]["date_future"] == 0


def test_score_ignores_partitioning(spark, sf):
    p = fixtures.people(spark, sf)
    one = score.score(p.coalesce(1), CFG).quality.first()
    many = score.score(p.repartition(8), CFG).quality.first()
    assert one == many and 0 <= one["score"] <= 100


def test_more_nulls_never_raise_completeness(spark, sf):
    p = fixtures.people(spark, sf)
    worse = p.withColumn("country", F.when(F.col("id") % 2 == 0, F.col("country")))
    def deducted(df):
        s = score.score(df, score.ScoreConfig("iqr", CFG.as_of, False, False))
        return s.points.where("dimension = 'completeness'").first()["deducted"]
    assert deducted(worse) >= deducted(p)


# ------------------------------------------------------------------ drift and changes
def test_same_table_does_not_drift(spark, sf):
    p = fixtures.people(spark, sf)
    got = drift.detect(p, p)
    assert got.where("is_drifted OR statistic > 1e-9").count() == 0


def test_chi_square_statistic(spark):
    a = frame(spark, "c", ["x"] * 10 + ["y"] * 20 + ["z"] * 30)
    b = frame(spark, "c", ["x"] * 20 + ["y"] * 20 + ["z"] * 20)
    r = drift.detect(a, b).first()
    assert r["statistic"] == pytest.approx(10.0, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.0067, abs=1e-4) and r["is_drifted"]


def test_unequal_totals_are_rescaled(spark):
    a = frame(spark, "c", ["x"] * 10 + ["y"] * 10)
    b = frame(spark, "c", ["x"] * 100 + ["y"] * 100)
    assert drift.detect(a, b).first()["statistic"] == pytest.approx(0.0, abs=1e-6)


def test_too_short_columns_are_not_tested(spark):
    a = frame(spark, "v", [1.0, 2.0], "double")
    assert drift.ks_statistics(a, a, ["v"]).count() == 0


def test_identical_versions_short_circuit(spark):
    a = frame(spark, "v", [1.0] * 9, "double")
    r = drift.between_versions(a, 3, a, 3).first()
    assert r["test"] == "identical" and not r["is_drifted"]


def test_column_changes(spark):
    a = spark.createDataFrame([(1, "x", 1)], "k int, gone string, t int")
    b = spark.createDataFrame([(1, "x", 1.0)], "k int, new string, t double")
    got = {(r["change"], r["column"]) for r in changes.column_changes(a, b).collect()}
    assert got == {("added", "new"), ("removed", "gone"), ("type", "t")}


# ------------------------------------------------------------------ root causes
PEN = "dimension string, reason string, impact string, deduction double, affected_columns array<string>"


def test_date_penalties_share_one_cap(spark):
    p = spark.createDataFrame([
        ("validity", "3 invalid date(s)", "medium", 10.0, ["d"]),
        ("consistency", "Mixed date formats", "high", 6.0, ["d"])], PEN)
    r = root_cause.deduplicate(p).first()
    assert (r["issue_group"], r["deduction"], r["saved"], r["impact"], r["merged"]) == (
        "DATE_QUALITY", 12.0, 4.0, "high", 2)
    assert root_cause.fair_score(root_cause.deduplicate(p)).first()["fair_score"] == 88.0


def test_dedup_never_costs_more(spark, sf):
    s = score.score(fixtures.people(spark, sf), CFG)
    d = root_cause.deduplicate(s.penalties).agg(F.sum("deduction"), F.sum("raw_deduction")).first()
    assert d[0] <= d[1]


def test_fix_steps_are_unique_and_ordered(spark, sf):
    p = fixtures.people(spark, sf)
    m = score.measure(p, CFG)
    steps = root_cause.fix_steps(p, root_cause.causes(m), m.missing).orderBy("position").collect()
    keys = [(r["column"], r["action"]) for r in steps]
    assert len(keys) == len(set(keys))
    rank = {"high": 0, "medium": 1, "low": 2}
    assert [rank[r["priority"]] for r in steps] == sorted(rank[r["priority"]] for r in steps)


# ------------------------------------------------------------------ repair and cleaning
def test_numeric_fill(spark):
    df = frame(spark, "v", [1.0, 2.0, 3.0, 4.0, 100.0, None], "double")
    out, n, _ = cleaning.fill_numeric(df)
    assert n == 1 and sorted(r[0] for r in out.collect())[2] == 3.0
    assert out.where("v = 3.0").count() == 2


def test_impossible_dates_stay_null(spark):
    df = frame(spark, "dob", ["03/04/1850"] * 2 + ["25/12/2020"] * 8)
    out, n, _ = cleaning.standardise_dates(df)
    assert out.where("dob IS NULL").count() == 2
    assert out.where("dob = '2020-12-25'").count() == 8 and n == 12


def test_dates_and_ids_are_no_numbers(spark):
    df = spark.createDataFrame([("20240101", "7", "5")] * 4, "date string, id string, v string")
    out, _, _ = cleaning.fix_mixed_types(df)
    assert dict(out.dtypes) == {"date": "string", "id": "string", "v": "double"}


def test_nulls_are_not_counted_as_changes(spark):
    df = spark.createDataFrame([(None, None), ("France", "a")], "country string, t string")
    assert cleaning.normalise_countries(df)[1] == 0
    assert cleaning.normalise_text(df)[1] == 0


def test_sequential_and_joint_outliers(spark):
    rows = [(float(i % 10), float(i % 7)) for i in range(100)] + [(500.0, 900.0), (3.0, 60.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    for mode in ("sequential", "joint"):
        out, gone, _ = cleaning.remove_outliers(df, mode)
        assert gone == 2 and out.count() == 100


def test_cleaning_settles(spark, sf):
    opts = cleaning.Options()
    once, steps, _ = cleaning.transform(fixtures.people(spark, sf), opts)
    assert [s.key for s in steps][:4] == [
        "junk_normalise", "mixed_type_fix", "domain_fix", "fill_numeric"]
    twice, _, _ = cleaning.transform(once, opts)
    again, left, _ = cleaning.transform(twice, opts)
    assert left == [] and again.count() == twice.count()


def test_good_tables_are_left_alone(spark):
    df = spark.createDataFrame([(float(i), f"n{i}") for i in range(50)], "v double, w string")
    got = cleaning.clean(df, config=score.ScoreConfig("iqr", CFG.as_of, False, False))
    r = got.report.first()
    assert r["skipped"] and r["score_delta"] == 0.0 and got.steps.count() == 0


def test_ledger_scores_add_up(spark, sf):
    cfg = score.ScoreConfig("iqr", CFG.as_of, False, False)
    got = cleaning.clean(fixtures.people(spark, sf).select("age", "country", "email"),
                         cleaning.Options(score_each_step=True, force_gate=True), cfg)
    gain = got.steps.agg(F.sum("score_gain")).first()[0]
    r = got.report.first()
    assert gain == pytest.approx(r["score_delta"], abs=0.05)


def test_suggestions_gate(spark, sf):
    p = fixtures.people(spark, sf)
    assert repair.gated(p, 81.0).count() == 0
    assert repair.gated(p, 80.0).count() > 0


# ------------------------------------------------------------------ history, alerts, report
def test_forecast_example(spark):
    h = spark.createDataFrame([("d", 1, 80.0), ("d", 2, 75.0), ("d", 3, 71.0), ("e", 1, 65.0)],
                              "dataset_id string, version long, score double")
    t = {r["dataset_id"]: r for r in forecast.trend(h).collect()}
    assert t["d"]["slope"] == pytest.approx(-4.5) and t["d"]["trend"] == "declining"
    assert (t["d"]["breach_version"], t["d"]["breach_risk"]) == (4, "high")
    assert (t["e"]["trend"], t["e"]["breach_risk"]) == ("stable", "high")
    f = forecast.forecast(forecast.trend(h)).where("dataset_id = 'd'").orderBy("version").collect()
    assert [(r["version"], r["score"]) for r in f] == [(4, 66.3), (5, 61.8), (6, 57.3)]


def test_version_store(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    a, b = spark.range(5), spark.range(7).withColumn("x", F.lit("y"))
    assert [store.register("d", a), store.register("d", b, ["added x"]),
            store.register("d", a)] == [1, 2, 3]
    store.restore("d", 1)
    assert store.current("d") == 1
    assert store.register("d", b) == 4  # never reuses a number
    with pytest.raises(ValueError):
        store.delete("d", 4)
    store.delete("d", 2)
    with pytest.raises(KeyError):
        store.read("d", 2)
    assert store.read("d").count() == 7
    got = versions.listing(store.log()).orderBy("version").collect()
    assert [(r["version"], r["is_latest"]) for r in got] == [(1, False), (3, False), (4, True)]
    r = versions.diff(store.log(), 1, 4).first()
    assert (r["row_delta"], r["columns_added"]) == (2, ["x"])


def test_report_of_a_healthy_table(spark):
    df = spark.createDataFrame([(float(i), f"n{i}") for i in range(50)], "v double, w string")
    s = score.score(df, score.ScoreConfig("iqr", CFG.as_of))
    f = report.facts(s)
    assert report.key_issues(f).first()["text"].startswith("No critical issues")
    assert report.summary(f).first()["usable"]


def test_full_report(spark, sf):
    p = fixtures.people(spark, sf)
    r = report.build(fixtures.people_v2(spark, sf), CFG, p)
    assert r.key_issues.count() == 5 and r.recommendations.count() <= 6
    assert r.summary.first()["status"] == "NOT RECOMMENDED"
    assert r.fix_pipeline.count() > 0 and r.drift.where("drift_detected").count() >= 1


# ------------------------------------------------------------------ sources
def test_csv_types_and_null_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e\n1,1.5,x,True,?\n,NA,N/A,False,3\n3,2,\"q,\"\"r\"\"\",True,4\n")
    df = readers.read(spark, str(path), "csv")
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "boolean", "string"]
    rows = df.collect()
    assert rows[1]["a"] is None and rows[1]["b"] is None and rows[1]["c"] is None
    assert rows[2]["c"] == 'q,"r"' and rows[0]["e"] == "?"


def test_json_array_of_records(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[{"a": 1, "b": "x"},\n {"a": null, "b": "N/A"}]')
    rows = readers.read(spark, str(path), "json").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "x"), (None, "N/A")]


def test_unknown_formats_are_refused(spark, tmp_path):
    with pytest.raises(readers.IngestError):
        readers.read(spark, "x.xlsx", "xlsx")
    with pytest.raises(readers.IngestError):
        writers.write(spark.range(1), str(tmp_path / "o"), "xlsx")
    with pytest.raises(readers.IngestError):
        readers.validate(spark.range(0))


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert readers.nan_to_null(df).where("v IS NULL").count() == 1


def test_exact_sample_ignores_partitioning(spark):
    df = spark.range(5000)
    a = {r[0] for r in readers.sample_exact(df, 100).collect()}
    b = {r[0] for r in readers.sample_exact(df.repartition(5), 100).collect()}
    assert len(a) == 100 and a == b


def test_delimiters(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d\n" * 5 + "a;b;c\n")
    lines = delimiters.read_lines(spark, str(path)).withColumn(
        "k", F.monotonically_increasing_id())
    r = delimiters.delimiter_report(lines).first()
    assert (r["primary"], r["mixed"], r["lines_affected"]) == ("comma", True, 1)
    assert delimiters.affected_lines(lines, "k").first()["k"] == 5
    none = delimiters.delimiter_report(frame(spark, "value", ["abc"])).first()
    assert (none["primary"], none["mixed"]) == ("comma", False)


# ------------------------------------------------------------------ plans
def test_scans_read_only_needed_columns(spark, sf):
    li = fixtures.table(spark, sf, "lineitem")
    plan = profile.numeric_stats(li, ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" in plan and "l_extendedprice" not in plan


def test_no_cartesian_products(spark, sf):
    m = score.measure(fixtures.people(spark, sf), CFG)
    plan = score.base_penalties(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_previous_row_across_ranges_of_a_hot_key(spark, ranges):
    from plumbline.operators.running import with_previous
    rows = [("hot", v, float(v * v)) for v in range(400)]
    rows += [(f"k{i}", v, float(i + v)) for i in range(40) for v in range(3)]
    df = spark.createDataFrame(rows, "k string, v int, x double").repartition(5)
    got = {(r["k"], r["v"]): r["prev_x"]
           for r in with_previous(df, "k", "v", ["x"], ranges).collect()}
    assert len(got) == len(rows)
    want = {(k, v): x for k, v, x in rows}
    assert all(p == want.get((k, v - 1)) for (k, v), p in got.items())


def test_large_samples_use_a_hash_cut(spark):
    df = spark.range(200_000)
    got = readers.sample_exact(df, 500)
    top = df.orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(500)
    assert {r[0] for r in got.collect()} == {r[0] for r in top.collect()}


def test_flagged_rows_are_counted_exactly(spark):
    df = frame(spark, "v", [float(x % 10) for x in range(100)] + [500.0] * 3, "double")
    assert anomalies.numeric_flags(df, "iqr").first()["n"] == 3


def test_user_columns_with_row_prefix_are_data(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "f")], "a int, _row_total int, _row_file string")
    writers.write(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["a", "_row_total"]
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    store.register("d", df)
    assert store.read("d").columns == ["a", "_row_total"]


def test_padded_dates_are_dates(spark):
    rows = [(" " * 40 + f"2024-01-{i % 28 + 1:02d}",) for i in range(30)]
    df = spark.createDataFrame(rows, "when_ string")
    assert anomalies.date_columns(df) == ["when_"]


def test_cells_of_padded_dates(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d}") for i in range(40)]
    df = spark.createDataFrame(rows + [(40, "  2024-02-30 "), (41, "2024-02-30")],
                               "id long, start_date string")
    found = anomalies.flagged(df, "iqr")
    got = anomalies.cells(df, found, ["id"]).where("method = 'date_validation'")
    assert {r["id"] for r in got.collect()} == {40, 41}


def test_pages_above_the_limit_are_refused(spark):
    df = spark.createDataFrame([("a",)], "column string")
    with pytest.raises(ValueError, match="500"):
        anomalies.page(df, 1, 500)


def test_empty_table_has_a_score(spark):
    df = spark.createDataFrame([], "id long, age int, email string, start_date string, d date")
    assert score.score(df, CFG).quality.count() == 1


def test_no_common_column(spark):
    a, b = spark.range(20).toDF("x"), spark.range(20).toDF("y")
    got = drift.detect(a, b)
    assert got.count() == 0 and "is_drifted" in got.columns


def test_typed_dates_cost_as_much_as_text(spark):
    rows = [(i, dt.date(1850, 1, 1) if i < 40 else dt.date(2020, 5, i % 28 + 1))
            for i in range(200)]
    df = spark.createDataFrame(rows, "n long, start_date date")
    text_df = df.withColumn("start_date", F.col("start_date").cast("string"))
    got = [sorted(map(str, score.score(x, CFG).penalties.collect())) for x in (df, text_df)]
    assert got[0] == got[1] and any("invalid date" in p for p in got[0])


def test_missing_dates_and_flags_are_filled(spark):
    rows = [(i, dt.date(2020, 1, 1) if i % 5 < 2 else None, True if i % 5 < 2 else None)
            for i in range(50)]
    df = spark.createDataFrame(rows, "n long, day date, flag boolean")
    got = {(r["column"], r["action"]): r["fill_value"] for r in repair.suggest(df).collect()}
    assert got["day", "fill_mode"] == "2020-01-01" and got["flag", "fill_mode"] == "true"
    assert ("day", "review_column") in got
    fills = root_cause.fill_values(df, profile.missing(df)).collect()
    assert {r["column"] for r in fills} == {"day", "flag"}


def test_all_remaining_issues(spark):
    df = spark.createDataFrame([(1,) + (None,) * 8], "a int, " + ", ".join(
        f"c{i} string" for i in range(8)))
    assert cleaning.remaining_issues(df).count() == 8


def test_surplus_fields_are_refused(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n4,5,6\n7\n")
    assert readers.csv_records(spark, str(path)).first() == (3, 1)
    with pytest.raises(readers.IngestError, match="1 record"):
        readers.read(spark, str(path), "csv")


def test_sources_without_records_are_refused(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n")
    with pytest.raises(readers.IngestError, match="no records"):
        readers.read(spark, str(path), "csv")


def test_outliers_write_nothing(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 10), float(i % 7)) for i in range(300)]
                               + [(1e6, 1.0), (1.0, 1e6)], "x double, y double")
    out, gone, _ = cleaning.remove_outliers(df)
    assert gone == 2 and "Filter" in out._jdf.queryExecution().optimizedPlan().toString()


def test_narrowing_merges_sketches_in_levels(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    got = exact_quantiles(df, ["x"], (0.25, 0.5), exact_limit=1000).first()
    ids = sorted(i * 7919 % 200_003 for i in range(200_000))
    h = 199_999 * 0.25
    assert got["q_25"] == ids[int(h)] + (h - int(h)) * (ids[int(h) + 1] - ids[int(h)])


def test_column_names_with_dots(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,price.usd,e mail.x,start_date\n" + "".join(
        f"{i},{i * 1.5},{'N/A' if i % 4 == 0 else 'a@b.co'},2024-01-{i % 28 + 1:02d}\n"
        for i in range(40)))
    df = readers.read(spark, str(path), "csv")
    assert df.schema["price.usd"].dataType.typeName() == "double"
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert rows["price.usd"]["max"] == 58.5 and rows["e mail.x"]["unique_count"] == 1
    assert score.score(df, score.ScoreConfig(as_of=dt.date(2025, 1, 1))).quality.count() == 1
    assert "price.usd" in {r["column"] for r in drift.detect(df, df).collect()}
    repair.suggest(df).collect()
    out = cleaning.clean(df, cleaning.Options(force_gate=True, remove_outliers=True), CFG)
    assert out.table.columns == df.columns


def test_cleaned_tables_become_versions(spark, tmp_path):
    df = spark.createDataFrame([(i % 30, "N/A" if i % 5 == 0 else " x ") for i in range(60)],
                               "k int, t string")
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    store.register("d", df)
    done = cleaning.clean(df, cleaning.Options(force_gate=True), CFG)
    assert cleaning.save(store, "d", done) == 2
    got = versions.metadata(store.log(), 2).first()
    assert got["source"] == "cleaning" and got["row_count"] == done.table.count()
    assert [c.split(":")[0] for c in got["changes"]] == [
        r["key"] for r in done.steps.orderBy("position").collect()]


def test_flagged_cells_by_shuffle_and_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, 9999 if i % 3 else 1) for i in range(90)], "id long, quantity int")
    found = anomalies.flagged(df, "iqr")
    small = sorted(map(str, anomalies.cells(df, found, ["id"]).collect()))
    monkeypatch.setattr(anomalies, "BROADCAST_VALUES", -1)
    assert len(small) == 60 and small == sorted(map(str, anomalies.cells(df, found, ["id"]).collect()))


@pytest.mark.parametrize("body, spans", [
    ("a,b\n1,2\n\n3,4\n", False), ('a,b\r\n"x, ""y""",2\r\n', False), ('a,b\n"x\ny",2\n', True),
    ('a,b\n"x\r\n\r\ny",2\n', True), ('a,b\n"x\ry",2\n', True), ('a,b\n5" pipe,2\n3,4\n', True),
    ("a,b\r1,2\r", True), ("a,b", False)])
def test_csv_is_split_where_no_record_spans_lines(spark, tmp_path, body, spans):
    path = tmp_path / "t.csv"
    path.write_bytes(body.encode())
    assert readers.spans_lines(spark, str(path)) == spans
    whole = readers.read_csv(spark, str(path), infer_types=False, multi_line=True).collect()
    assert readers.read_csv(spark, str(path), infer_types=False).collect() == whole


def test_large_csv_is_split(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + '"some, text",12345678\n' * 600_000)
    got = readers.read_csv(spark, str(path), infer_types=False)
    assert got.rdd.getNumPartitions() > 1 and got.count() == 600_000


@pytest.mark.parametrize("extra", [1, 15, 16, 17, 40, 400])
@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_surplus_fields_are_never_lost(spark, tmp_path, extra, multi_line):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n3,4" + "," * extra + "LOST\n5\n")
    with pytest.raises(readers.IngestError, match="1 record"):
        readers.read_csv(spark, str(path), multi_line=multi_line)
    path.write_text("a,b\n1,2\n3,4" + "," * extra + '\n5\n"x,y","7,""8"""\n')
    got = readers.read_csv(spark, str(path), multi_line=multi_line).collect()
    assert [tuple(r) for r in got] == [("1", "2"), ("3", "4"), ("5", None), ("x,y", '7,"8"')]


def test_rows_without_duplicates_are_not_exchanged(spark):
    rows = [(i % 900, f"text {i % 900}", None if i % 2 else 1.5, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string, x double, _row_index long").repartition(4)
    after, gone = profile.without_duplicates(df)
    kept = sorted(after.collect())
    assert gone == 100 and [r["_row_index"] for r in kept] == list(range(900))
    assert [tuple(r) for r in kept] == rows[:900]
    plan = after.select("k")._jdf.queryExecution().executedPlan().toString()
    alone = plan[plan.index("Union"):plan.index("HashAggregate")]  # the branch of rows that stay
    assert "LeftAnti" in alone and "Exchange hashpartitioning" not in alone
    unique = df.where("_row_index < 500")
    assert profile.without_duplicates(unique)[1] == 0


def test_score_measures_all_cells_in_one_pass(spark):
    """Text facts, threats and personal data agree with their own operators."""
    df = fixtures.people(spark, "/root/testdata/sf0.001")
    m = score.measure(df, score.ScoreConfig(as_of=dt.date(2024, 6, 1)))
    own = facts.text_facts(df, dt.date(2024, 6, 1))
    def rows(d):
        return sorted(map(str, d.select(sorted(d.columns)).collect()))
    assert rows(m.text) == rows(own)
    assert rows(m.threats) == rows(security.threat_counts(df))
    assert rows(m.pii) == rows(pii.columns(pii.match_counts(df)))
    assert rows(m.size.select("null_rows", "rows")) == rows(profile.null_rows(df))
    assert rows(m.missing) == rows(profile.missing(df))
    assert rows(m.anomalies) == rows(anomalies.detect(df, "all"))


def test_sequential_fences_equal_one_column_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.lognormal(0, 1, (3000, 6))
    x[:, 3] = np.where(rng.random(3000) < 0.1, x[:, 2] * 30, x[:, 3])
    x[::50, 4] = np.nan
    names = [f"c{i}" for i in range(6)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    left = pd.DataFrame(x, columns=names)
    for n in names:
        q1, q3 = left[n].quantile([0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        left = left[left[n].isna() | left[n].between(lo, hi)]
    searched = []
    search = cleaning.exact_quantiles
    monkeypatch.setattr(cleaning, "exact_quantiles",
                        lambda *a, **k: searched.append(1) or search(*a, **k))
    after, gone, _ = cleaning.remove_outliers(df)
    assert gone == 3000 - len(left)
    assert sorted(r["c0"] for r in after.collect()) == sorted(left["c0"])
    assert len(searched) <= 5  # not one per column
