"""Version log, score history, forecast and alerts over the metadata views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import alerts, forecast, profile, score, versions
from plumbline.plans import fixtures as fx
from plumbline.plans import sqltext as s
from plumbline.plans.registry import query
from plumbline.plans.session import scratch_path


def _log(spark, d):
    return fx.view(spark, d, fx.VERSIONS, "orders")


def _scores(spark, d):
    return fx.view(spark, d, fx.QUALITY_HISTORY, "events")


def _alerts(spark, d):
    return fx.view(spark, d, fx.ALERTS, "events")


def _datasets(spark, d):
    return fx.view(spark, d, fx.DATASETS, "customer")


_LOG = f"log AS ({fx.VERSIONS})"
_LIVE = """live AS (SELECT dataset_id, version, max(row_count) AS row_count,
  min(event_time) AS created_at FROM log GROUP BY 1, 2 HAVING NOT bool_or(event = 'delete'))"""
_CURRENT = """cur AS (SELECT dataset_id, arg_max(version, (event_time, version)) AS version
  FROM log WHERE event <> 'delete' GROUP BY 1)"""
_WITH = f"WITH {_LOG}, {_LIVE}, {_CURRENT}"


@query("current_version", f"{_WITH} SELECT * FROM cur")
def current_version(spark, d):
    return versions.current(_log(spark, d))


@query("version_list", f"""{_WITH} SELECT dataset_id, l.version, row_count, created_at,
  CASE WHEN l.version > 1 THEN 'cleaning' ELSE 'upload' END AS source,
  CASE WHEN l.version > 1 THEN l.version - 1 END AS parent_version,
  l.version = c.version AS is_latest FROM live l JOIN cur c USING (dataset_id)""")
def version_list(spark, d):
    return versions.newest_first(versions.listing(_log(spark, d)))


@query("version_metadata", f"{_WITH} SELECT dataset_id, version FROM live WHERE version = 2")
def version_metadata(spark, d):
    return versions.resolve(_log(spark, d), 2)


@query("version_diff", f"""{_WITH} SELECT dataset_id, version_a, version_b, rows_a, rows_b,
  rows_b - rows_a AS row_delta FROM (SELECT dataset_id, lag(version) OVER w AS version_a,
    version AS version_b, lag(row_count) OVER w AS rows_a, row_count AS rows_b FROM live
    WINDOW w AS (PARTITION BY dataset_id ORDER BY version)) WHERE version_a IS NOT NULL""")
def version_diff(spark, d):
    return versions.diff_consecutive(_log(spark, d))


@query("version_next", f"""WITH {_LOG}
SELECT dataset_id, max(version) + 1 AS version FROM log GROUP BY 1""")
def version_next(spark, d):
    return versions.next_version(_log(spark, d))


@query("version_restore", f"""{_WITH}, restored AS (SELECT dataset_id, min(version) AS version
  FROM live GROUP BY 1) SELECT dataset_id, version FROM restored""")
def version_restore(spark, d):
    """Append a restore of each dataset's oldest live version; it becomes current."""
    log = _log(spark, d)
    oldest = versions.live(log).groupBy("dataset_id").agg(F.min("version").alias("version"))
    events = oldest.select("dataset_id", "version", F.lit("restore").alias("event"),
                           F.lit(None).cast("bigint").alias("row_count"),
                           F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")).alias("event_time"))
    return versions.current(log.unionByName(events))


@query("version_delete", f"""{_WITH} SELECT dataset_id, l.version FROM live l
JOIN cur c USING (dataset_id) WHERE l.version <> c.version""")
def version_delete(spark, d):
    """Versions that may be deleted."""
    return versions.deletable(_log(spark, d))


def _store(spark, d):
    """Two versions of people in a store, the second one cleaned; the first is current again."""
    store = versions.VersionStore(spark, scratch_path(spark, "versions"))
    store.register("people", fx.people(spark, d))
    store.register("people", fx.people_v2(spark, d), ["salary raised", "notes renamed"])
    store.restore("people", 1)
    return store


@query("version_store", f"""{s.both_versions()} SELECT 1::BIGINT AS version, count(*) AS row_count,
  'upload' AS source, NULL::BIGINT AS parent_version, true AS is_latest FROM people
UNION ALL SELECT 2, count(*), 'cleaning', 1, false FROM people_v2""")
def version_store(spark, d):
    """What a store lists after two registrations and a restore."""
    return versions.listing(_store(spark, d).log()).drop("dataset_id", "created_at")


@query("version_store_metadata", f"""{s.both_versions()} SELECT 2::BIGINT AS version,
  count(*) AS row_count, 12::BIGINT AS col_count, '{",".join(fx.PEOPLE_V2)}' AS columns,
  'salary raised,notes renamed' AS changes, 'cleaning' AS source, 1::BIGINT AS parent_version,
  false AS is_latest FROM people_v2""")
def version_store_metadata(spark, d):
    """All that a store knows of one version."""
    return versions.metadata(_store(spark, d).log(), 2).select(
        "version", "row_count", "col_count", F.array_join("columns", ",").alias("columns"),
        F.array_join("changes", ",").alias("changes"), "source", "parent_version", "is_latest")


@query("version_store_diff", f"""{s.both_versions()} SELECT a AS rows_a, b AS rows_b,
  b - a AS row_delta, 12::BIGINT AS cols_a, 12::BIGINT AS cols_b, 0::BIGINT AS col_delta,
  'segment' AS columns_added, 'notes' AS columns_removed, 'salary raised,notes renamed' AS changes
FROM (SELECT (SELECT count(*) FROM people) AS a, (SELECT count(*) FROM people_v2) AS b)""")
def version_store_diff(spark, d):
    """Rows, columns and changes between two registered versions."""
    return versions.diff(_store(spark, d).log(), 1, 2).select(
        "rows_a", "rows_b", "row_delta", "cols_a", "cols_b", "col_delta",
        F.array_join("columns_added", ",").alias("columns_added"),
        F.array_join("columns_removed", ",").alias("columns_removed"),
        F.array_join("changes_in_b", ",").alias("changes"))


@query("fingerprint")
def fingerprint(spark, d):
    return versions.fingerprint(fx.table(spark, d, "lineitem"))


@query("fingerprint_invariant", "SELECT true AS same, count(*) AS rows FROM orders")
def fingerprint_invariant(spark, d):
    """The checksum does not depend on row order or partitioning."""
    o = fx.table(spark, d, "orders")
    a, b = versions.fingerprint(o), versions.fingerprint(o.repartition(7, "o_custkey"))
    return a.join(b.withColumnRenamed("checksum", "c"), "rows").select(
        (F.col("checksum") == F.col("c")).alias("same"), "rows")


@query("fingerprint_differs", """SELECT count(*) AS rows, true AS moved_nulls, true AS one_cell
FROM orders""")
def fingerprint_differs(spark, d):
    """Tables that differ in where their nulls stand, or in one cell, differ in checksum."""
    o = fx.table(spark, d, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    priority, comment = F.col("o_orderpriority"), F.lit("x")
    a = o.select("o_orderkey", F.when(odd, priority).alias("p"), F.when(~odd, priority).alias("q"))
    b = o.select("o_orderkey", F.when(~odd, priority).alias("p"), F.when(odd, priority).alias("q"))
    least = o.agg(F.min("o_orderkey")).scalar()
    c = a.withColumn("p", F.when(F.col("o_orderkey") == least, comment).otherwise(F.col("p")))
    x, y, z = (versions.fingerprint(t).withColumnRenamed("checksum", n)
               for t, n in ((a, "x"), (b, "y"), (c, "z")))
    return x.join(y, "rows").join(z, "rows").select(
        "rows", (F.col("x") != F.col("y")).alias("moved_nulls"),
        (F.col("x") != F.col("z")).alias("one_cell"))


@query("dataset_search", f"""WITH ds AS ({fx.DATASETS}) SELECT * FROM ds
WHERE contains(lower(name), lower('#00000001'))""")
def dataset_search(spark, d):
    return versions.search(_datasets(spark, d), "#00000001")


@query("dataset_types", f"""WITH ds AS ({fx.DATASETS})
SELECT file_type, count(*) AS datasets FROM ds GROUP BY 1""")
def dataset_types(spark, d):
    return versions.by_file_type(_datasets(spark, d))


_HIST = f"h AS ({fx.QUALITY_HISTORY})"


@query("version_delta", f"""WITH {_HIST}, q AS (SELECT *, round(score - lag(score) OVER (
  PARTITION BY dataset_id ORDER BY version), 2) AS delta
  FROM (SELECT dataset_id, version, floor(score) AS score FROM h))
SELECT dataset_id, version, score, delta, CASE WHEN delta IS NULL THEN NULL
  WHEN delta <= -20 THEN 'unstable' WHEN delta <= -10 THEN 'degraded' WHEN delta >= 5
  THEN 'improved' ELSE 'stable' END AS status FROM q""")
def version_delta(spark, d):
    whole = _scores(spark, d).withColumn("score", F.floor("score").cast("double"))
    return score.version_delta(whole)


_FIT = f"""{_HIST}, fit AS (SELECT dataset_id, count(*) AS versions, max(version) AS last_version,
  arg_max(score, version) AS cur, CASE WHEN count(*) >= 2 THEN regr_slope(score, version)
  ELSE 0.0 END AS slope, CASE WHEN count(*) >= 2 THEN regr_intercept(score, version) END AS icept
  FROM h GROUP BY 1),
t AS (SELECT *, CASE WHEN slope < -1 THEN 'declining' WHEN slope > 1 THEN 'improving'
  ELSE 'stable' END AS trend, CASE WHEN slope < 0 AND cur > 40 AND (40 - icept) / slope
  > last_version THEN CAST(ceil((40 - icept) / slope) AS BIGINT) END AS breach FROM fit)"""


@query("score_trend", f"""WITH {_FIT}
SELECT dataset_id, versions, last_version, round(cur, 6) AS current_score,
  round(slope, 5) AS slope, round(icept, 5) AS intercept, trend, breach AS breach_version,
  CASE WHEN cur < 40 THEN 'high' WHEN breach - last_version <= 2 THEN 'high'
    WHEN breach - last_version <= 5 THEN 'medium' WHEN breach IS NOT NULL THEN 'low'
    WHEN trend = 'declining' THEN 'medium' ELSE 'none' END AS breach_risk FROM t""")
def score_trend(spark, d):
    """All datasets at once, with an SLA of 40 (event scores are low)."""
    return forecast.trend(_scores(spark, d), 40.0).select(
        "dataset_id", "versions", "last_version",
        F.round("current_score", 6).alias("current_score"), F.round("slope", 5).alias("slope"),
        F.round("intercept", 5).alias("intercept"), "trend", "breach_version", "breach_risk")


@query("score_forecast", f"""WITH {_FIT}
SELECT dataset_id, last_version + k AS version,
  round(greatest(0.0, least(100.0, slope * (last_version + k) + icept)), 1) AS score
FROM t, (SELECT unnest(range(1, 4)) AS k) WHERE versions >= 2""")
def score_forecast(spark, d):
    return forecast.forecast(forecast.trend(_scores(spark, d)))


_AL = f"a AS ({fx.ALERTS}), ds AS ({fx.DATASETS})"


@query("alert_list", f"""WITH {_AL} SELECT a.* FROM a
WHERE dataset_id IN (SELECT dataset_id FROM ds)""")
def alert_list(spark, d):
    return alerts.listing(_alerts(spark, d), _datasets(spark, d))


@query("alert_state", f"""WITH {_AL} SELECT alert_id, dataset_id, alert_type, severity,
  triggered_at, is_read OR alert_id % 10 = 4 AS is_read FROM a WHERE dataset_id NOT IN (
  SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def alert_state(spark, d):
    """Read events and deleted datasets applied to the append-only alert table."""
    a = _alerts(spark, d)
    read = a.where("alert_id % 10 = 4").select("alert_id")
    gone = fx.table(spark, d, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("dataset_id"))
    return alerts.latest_state(a, read, gone)


def _roll(by):
    return (f"WITH {_AL} SELECT {by}, count(*) AS alerts, count_if(NOT is_read) AS unread "
            f"FROM a GROUP BY 1")


@query("alerts_by_severity", _roll("severity"))
def alerts_by_severity(spark, d):
    return alerts.rollup(_alerts(spark, d), "severity")


@query("alerts_by_type", _roll("alert_type"))
def alerts_by_type(spark, d):
    return alerts.rollup(_alerts(spark, d), "alert_type")


@query("alert_totals", f"""WITH {_AL} SELECT count(*) AS alerts, count_if(NOT is_read) AS unread,
count_if(severity = 'critical') AS critical FROM a""")
def alert_totals(spark, d):
    return alerts.totals(_alerts(spark, d))


@query("alerts_urgent", f"""WITH {_AL} SELECT * FROM a ORDER BY CASE severity
WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, triggered_at DESC,
alert_id LIMIT 6""")
def alerts_urgent(spark, d):
    """The six alerts a dashboard shows."""
    return alerts.most_urgent(_alerts(spark, d), 6)


@query("alerts_recent_high", f"""WITH {_AL} SELECT * FROM a WHERE severity = 'high'
ORDER BY triggered_at DESC, alert_id LIMIT 5""")
def alerts_recent_high(spark, d):
    return alerts.most_urgent(_alerts(spark, d), 5, "high")


@query("quality_alerts", f"""WITH {_HIST} SELECT dataset_id, version, 'quality_degraded'
AS alert_type, CASE WHEN score < 40 THEN 'critical' ELSE 'high' END AS severity FROM h
WHERE score < 60""")
def quality_alerts(spark, d):
    return alerts.quality_alerts(_scores(spark, d)).select(
        "dataset_id", "version", "alert_type", "severity")


@query("missing_alerts", f"""{s.both_versions(s.cells(source='people'))}
SELECT "column", CASE WHEN p >= 50 THEN 'critical' ELSE 'high' END AS severity FROM (
  SELECT "column", (count(*) - count({s.null_words('v')})) * 100.0 / count(*) AS p FROM (
    SELECT 'phone' AS "column", CASE WHEN v IN ('000-000-0000', '123-45-6789') THEN NULL
      ELSE v END AS v FROM cells WHERE "column" = 'phone'
    UNION ALL SELECT "column", CASE WHEN v LIKE 'u%' THEN NULL ELSE v END FROM cells
      WHERE "column" = 'email') GROUP BY 1) WHERE p >= 20""")
def missing_alerts(spark, d):
    """Two columns thinned out so that one alert of each severity is due."""
    df = fx.people(spark, d).select(
        F.when(~F.col("phone").isin("000-000-0000", "123-45-6789"), F.col("phone"))
        .alias("phone"),
        F.when(~F.col("email").startswith("u"), F.col("email")).alias("email"))
    return alerts.missing_alerts(profile.missing(df), "people", 1).select(
        F.col("details")["column"].alias("column"), "severity")


@query("alerts_new", f"""WITH {_HIST} SELECT count(*) AS raised FROM h
WHERE score < 60 AND version > 3""")
def alerts_new(spark, d):
    """Raising all alerts again adds only those of versions not seen before."""
    h = _scores(spark, d)
    known = alerts.quality_alerts(h.where("version <= 3"))
    again = alerts.quality_alerts(h)
    return alerts.new_alerts(again, known).agg(F.count("*").alias("raised"))
