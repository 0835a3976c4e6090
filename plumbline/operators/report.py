"""Report tables built from the score, anomaly, PII, security and drift tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import drift as drifting
from plumbline.operators import pii, profile, root_cause, score, security
from plumbline.operators.cells import pin

KEY_ISSUES, RECOMMENDATIONS = 5, 6


@dataclass(frozen=True)
class Report:
    summary: DataFrame
    key_issues: DataFrame
    anomalies: DataFrame
    drift: DataFrame
    pii: DataFrame
    security: DataFrame
    recommendations: DataFrame
    fix_pipeline: DataFrame
    dedup_penalties: DataFrame
    fair_score: DataFrame


def _items(facts: DataFrame, rules: list[tuple[Column, Column]], limit: int,
           otherwise: str) -> DataFrame:
    """position, text: the first rules that hold, in order; one fallback line if none does."""
    all_rules = F.array(*[F.when(cond, text) for cond, text in rules])
    kept = F.filter(all_rules, lambda x: x.isNotNull())
    shown = F.when(F.size(kept) > 0, F.slice(kept, 1, limit)).otherwise(F.array(F.lit(otherwise)))
    return facts.select(F.posexplode(shown).alias("p", "text")).select(
        (F.col("p") + 1).cast("bigint").alias("position"), "text")


def facts(s: score.Scored, drift: DataFrame | None = None) -> DataFrame:
    """One row with everything the report rules read."""
    m = s.measures
    n = F.col("distinct_values")
    anomalies = m.anomalies.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("anomalies"),
        F.max_by("column", F.struct(n, F.col("column"))).alias("worst_column"),
        F.max(n).alias("worst_values"),
        F.array_sort(F.collect_list(F.when(n >= 5, F.col("column")))).alias("busy_columns"))
    pen = s.penalties.agg(
        F.count_if(F.col("dimension") == "validity").alias("validity_issues"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(
            F.col("dimension") == "validity", F.col("affected_columns")))))).alias(
                "validity_columns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(
            (F.col("dimension") == "consistency")
            & F.lower("reason").contains("date format"), F.col("affected_columns")))))).alias(
                "format_columns"))
    dims = s.dimensions.agg(*[
        F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d)
        for d in ("completeness", "uniqueness")])
    out = s.quality
    for part in (anomalies, pen, dims):
        for c in part.columns:
            out = out.withColumn(c, part.select(c).scalar())
    high = (m.pii.where("confidence = 'high'").agg(F.array_sort(F.collect_list("column")))
            .scalar() if m.pii is not None else F.array().cast("array<string>"))
    drifted = (drift.agg(F.count_if("is_drifted")).scalar() if drift is not None
               else F.lit(0))
    return out.withColumn("high_pii", high).withColumn("drifted", drifted)


def key_issues(f: DataFrame) -> DataFrame:
    """At most five issues in a fixed order."""
    c = F.col
    return _items(f, [
        (c("missing_pct") > 20, F.format_string(
            "%.1f%% of values are missing, a significant gap", "missing_pct")),
        ((c("missing_pct") > 5) & (c("missing_pct") <= 20), F.format_string(
            "%.1f%% of values are missing, consider imputation", "missing_pct")),
        (c("dup_pct") > 0, F.format_string("%.1f%% of rows are duplicates", "dup_pct")),
        (c("anomalies") > 0, F.format_string(
            "%d anomalous values in %d column(s), worst '%s' (%d)", "anomalies",
            "anomalous_columns", "worst_column", "worst_values")),
        (c("validity_issues") > 0, F.concat(
            c("validity_issues").cast("string"), F.lit(" validity issue(s) in "),
            F.array_join(F.slice("validity_columns", 1, 5), ", "))),
        (F.size("format_columns") > 0, F.concat(
            F.lit("Mixed date formats in "), F.array_join("format_columns", ", "))),
        (c("threats") > 0, F.format_string("%d security threat(s)", "threats")),
        (c("pii_columns") > 0, F.format_string("PII in %d column(s)", "pii_columns")),
        (c("score") < 40, F.format_string("Score is critically low (%.0f)", "score")),
    ], KEY_ISSUES, "No critical issues; the table looks healthy")


def recommendations(f: DataFrame) -> DataFrame:
    """At most six actions in a fixed order."""
    c = F.col
    return _items(f, [
        (c("missing_pct") > 5, F.lit("Fill missing values by median or mode")),
        (F.size("busy_columns") > 0, F.concat(
            F.lit("Review outliers in "), F.array_join(F.slice("busy_columns", 1, 3), ", "))),
        (c("threats") > 0, F.lit("Strip or escape injection payloads")),
        (F.size("high_pii") > 0, F.concat(
            F.lit("Mask personal data in "), F.array_join(F.slice("high_pii", 1, 3), ", "))),
        (c("drifted") > 0, F.format_string(
            "Check the sources of %d drifted column(s)", "drifted")),
        (c("completeness") < 70, F.lit("Run the cleaning pipeline to complete the data")),
        (c("uniqueness") < 70, F.lit("Remove duplicate rows")),
        (c("score") < 60, F.lit("Apply all suggested repairs with the cleaning pipeline")),
    ], RECOMMENDATIONS, "Quality is acceptable; keep monitoring new versions")


def score_label(s: Column) -> Column:
    return (F.when(s >= 90, "Excellent").when(s >= 75, "Good").when(s >= 60, "Fair")
            .when(s >= 40, "Poor").otherwise("Critical"))


def summary(f: DataFrame) -> DataFrame:
    """One row: score, grade, label, usable, status, risks."""
    c = F.col
    risks = F.filter(F.array(
        F.when(c("threats") > 0, "security payloads"),
        F.when(F.size("high_pii") > 0, "personal data"),
        F.when(c("drifted") > 0, "data drift")), lambda x: x.isNotNull())
    return f.select(
        "score", "grade", score_label(c("score")).alias("label"),
        (c("score") >= 60).alias("usable"),
        F.when(c("score") >= 60, "USABLE").otherwise("NOT RECOMMENDED").alias("status"),
        risks.alias("risks"))


def anomaly_rows(found: DataFrame) -> DataFrame:
    """column, methods, affected, severity by the number of values, most affected first."""
    n = F.col("distinct_values")
    return found.select(
        "column", F.array_join("methods_used", ", ").alias("methods"), n.alias("affected"),
        F.when(n >= 20, "high").when(n >= 5, "medium").otherwise("low").alias("severity")
    ).orderBy(F.desc("affected"), "column")


def drift_rows(drift: DataFrame) -> DataFrame:
    """column, drift_detected, p_value, severity; drifted columns first."""
    return drift.select(
        "column", F.col("is_drifted").alias("drift_detected"), "p_value",
        F.when(F.col("is_drifted"), drifting.severity(F.col("p_value"))).otherwise("low")
        .alias("severity")).orderBy(F.desc("drift_detected"), "column")


def pii_rows(found: DataFrame) -> DataFrame:
    return found.select("column", "pii_type", F.col("confidence").alias("risk_level"))


def security_lines(counts: DataFrame) -> DataFrame:
    """column, threat_type, rows."""
    return counts.select("column", "threat_type", F.col("n").alias("rows"))


def build(df: DataFrame, config: score.ScoreConfig = score.ScoreConfig(),
          previous: DataFrame | None = None) -> Report:
    """All report tables for df; previous is the version to compare with."""
    s = score.score(df, config)
    m = s.measures
    drift = pin(drifting.detect(previous, df)) if previous is not None else None
    f = pin(facts(s, drift))
    dedup = root_cause.deduplicate(s.penalties)
    spark = df.sparkSession
    none = spark.createDataFrame([], "column string, drift_detected boolean, p_value double, "
                                     "severity string")
    return Report(
        summary=summary(f), key_issues=key_issues(f), anomalies=anomaly_rows(m.anomalies),
        drift=drift_rows(drift) if drift is not None else none,
        pii=pii_rows(m.pii) if m.pii is not None else none.select("column"),
        security=security_lines(m.threats) if m.threats is not None else none.select("column"),
        recommendations=recommendations(f),
        fix_pipeline=root_cause.fix_steps(df, root_cause.causes(m), profile.missing(df)),
        dedup_penalties=dedup, fair_score=root_cause.fair_score(dedup))


def analyze(df: DataFrame, config: score.ScoreConfig = score.ScoreConfig(method="iqr")
            ) -> DataFrame:
    """One row: score, grade, anomalous_columns, pii_risk, threats, rows."""
    s = score.score(df, config)
    m = s.measures
    return s.quality.select("score", "grade", "anomalous_columns", "rows").withColumn(
        "pii_risk", pii.risk(m.pii).select("risk_level").scalar()).withColumn(
        "threats", security.verdict(m.threats).select("total_threats").scalar())
