"""Alerts raised from result tables, and the alert list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT = ("alert_id", "dataset_id", "version", "alert_type", "severity", "message", "details")


def _alert(kind: str, severity: Column, message: Column, subject: Column,
           details: dict[str, Column]) -> list[Column]:
    """The id is a hash of what the alert is about: raising it again gives the same id."""
    pairs = [x for k, c in details.items() for x in (F.lit(k), c.cast("string"))]
    return [F.sha2(F.concat_ws("|", F.col("dataset_id").cast("string"),
                               F.col("version").cast("string"), F.lit(kind), subject), 256)
            .alias("alert_id"), F.col("dataset_id"), F.col("version"),
            F.lit(kind).alias("alert_type"), severity.alias("severity"),
            message.alias("message"), F.create_map(*pairs).alias("details")]


def _scoped(df: DataFrame, dataset_id, version) -> DataFrame:
    out = df if "dataset_id" in df.columns else df.withColumn("dataset_id", F.lit(dataset_id))
    return out if "version" in out.columns else out.withColumn("version", F.lit(version))


def missing_alerts(missing: DataFrame, dataset_id=None, version=None) -> DataFrame:
    """One alert per column with at least 20 % missing cells; critical from 50 %."""
    p = F.col("missing_pct")
    return _scoped(missing, dataset_id, version).where(p >= 20).select(*_alert(
        "high_missing", F.when(p >= 50, "critical").otherwise("high"),
        F.format_string("Column '%s' has %.2f%% missing cells", "column", "missing_pct"),
        F.col("column"), {"column": F.col("column"), "missing_pct": p}))


def anomaly_alerts(found: DataFrame, dataset_id=None, version=None) -> DataFrame:
    """One alert per table, by the total number of anomalous values."""
    per = _scoped(found, dataset_id, version).groupBy("dataset_id", "version").agg(
        F.sum("distinct_values").alias("total"),
        F.array_sort(F.collect_list("column")).alias("columns"))
    t = F.col("total")
    return per.where(t > 0).select(*_alert(
        "anomaly_detected",
        F.when(t > 100, "critical").when(t > 20, "high").otherwise("medium"),
        F.format_string("%d anomalous value(s) in %d column(s)", t, F.size("columns")),
        F.lit(""), {"total": t, "columns": F.array_join("columns", ",")}))


def quality_alerts(quality: DataFrame, dataset_id=None, version=None) -> DataFrame:
    """Score below 60; critical below 40."""
    s = F.col("score")
    return _scoped(quality, dataset_id, version).where(s < 60).select(*_alert(
        "quality_degraded", F.when(s < 40, "critical").otherwise("high"),
        F.format_string("Quality score is %.2f", s), F.lit(""), {"score": s}))


def drift_alerts(drift: DataFrame, dataset_id=None, version=None) -> DataFrame:
    """One alert per comparison with at least one drifted column."""
    per = _scoped(drift, dataset_id, version).where("is_drifted").groupBy(
        "dataset_id", "version").agg(F.array_sort(F.collect_list("column")).alias("columns"))
    return per.select(*_alert(
        "drift_detected", F.lit("high"),
        F.format_string("%d column(s) drifted", F.size("columns")), F.lit(""),
        {"columns": F.array_join("columns", ",")}))


def new_alerts(raised: DataFrame, known: DataFrame) -> DataFrame:
    """Alerts not raised before."""
    return raised.dropDuplicates(["alert_id"]).join(
        known.select("alert_id"), "alert_id", "left_anti")


def listing(alerts: DataFrame, datasets: DataFrame, dataset_id=None) -> DataFrame:
    """Newest first; alerts of datasets that no longer exist are left out."""
    if dataset_id is not None:
        kept = alerts.where(F.col("dataset_id") == dataset_id)
    else:
        kept = alerts.join(datasets.select("dataset_id"), "dataset_id", "left_semi")
    return kept.orderBy(F.desc("triggered_at"), "alert_id")


def latest_state(alerts: DataFrame, read_events: DataFrame, deleted: DataFrame) -> DataFrame:
    """Alerts with is_read set by read events (alert_id) and without those of deleted
    datasets (dataset_id); nothing is rewritten in place."""
    read = read_events.select("alert_id").distinct().withColumn("marked", F.lit(True))
    return (alerts.join(deleted.select("dataset_id").distinct(), "dataset_id", "left_anti")
            .join(read, "alert_id", "left")
            .withColumn("is_read", F.col("is_read") | F.coalesce("marked", F.lit(False)))
            .drop("marked"))


def rollup(alerts: DataFrame, by: str) -> DataFrame:
    """by ('severity' or 'alert_type'), alerts, unread."""
    return alerts.groupBy(by).agg(F.count("*").alias("alerts"),
                                  F.count_if(~F.col("is_read")).alias("unread"))


def totals(alerts: DataFrame) -> DataFrame:
    """One row: alerts, unread, critical."""
    return alerts.agg(F.count("*").alias("alerts"),
                      F.count_if(~F.col("is_read")).alias("unread"),
                      F.count_if(F.col("severity") == "critical").alias("critical"))


def severity_rank(c: Column) -> Column:
    return (F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2)
            .otherwise(3))


def most_urgent(alerts: DataFrame, n: int, severity: str | None = None) -> DataFrame:
    """The n most severe alerts, newest first within a severity."""
    kept = alerts.where(F.col("severity") == severity) if severity else alerts
    return kept.orderBy(severity_rank(F.col("severity")), F.desc("triggered_at"),
                        "alert_id").limit(n)
