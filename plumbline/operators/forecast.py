"""Score trend and forecast for all datasets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import score as scoring
from plumbline.operators.cells import small_frame, together


def history(tables: dict[tuple[str, int], DataFrame],
            config: scoring.ScoreConfig = scoring.ScoreConfig()) -> DataFrame:
    """dataset_id, version, score of the given versions, which are scored side by side."""
    spark = next(iter(tables.values())).sparkSession
    scores = together(*[lambda t=t: float(scoring.score(t, config).quality.first()["score"])
                        for t in tables.values()])
    rows = [(d, v, s) for (d, v), s in zip(tables, scores)]
    return small_frame(spark, rows, "dataset_id string, version bigint, score double")


def trend(scores: DataFrame, sla: float = vocab.SLA_SCORE) -> DataFrame:
    """One row per dataset: versions, last_version, current_score, slope, intercept, trend,
    breach_version, breach_risk, message.

    All pieces are mergeable aggregates, so one shuffle of (dataset, partition) rows.
    """
    v, s = F.col("version").cast("double"), F.col("score")
    fit = scores.groupBy("dataset_id").agg(
        F.count("*").alias("versions"), F.max("version").alias("last_version"),
        F.max_by("score", "version").alias("current_score"),
        F.regr_slope(s, v).alias("raw_slope"), F.regr_intercept(s, v).alias("raw_intercept"))
    many = F.col("versions") >= 2
    slope, cur, last = F.col("slope"), F.col("current_score"), F.col("last_version")
    cross = (F.lit(float(sla)) - F.col("intercept")) / slope
    breach, gap = F.col("breach_version"), F.col("breach_version") - last
    kind = F.col("trend")
    out = (fit.withColumn("slope", F.when(many, F.col("raw_slope")).otherwise(0.0))
           .withColumn("intercept", F.when(many, F.col("raw_intercept")))
           .withColumn("trend", F.when(slope < -1, "declining").when(slope > 1, "improving")
                       .otherwise("stable"))
           .withColumn("breach_version", F.when(
               (slope < 0) & (cur > sla) & (cross > last), F.ceil(cross)).cast("bigint"))
           .withColumn("breach_risk", F.when(cur < sla, "high")
                       .when(breach.isNotNull() & (gap <= 2), "high")
                       .when(breach.isNotNull() & (gap <= 5), "medium")
                       .when(breach.isNotNull(), "low")
                       .when(kind == "declining", "medium").otherwise("none")))
    message = (F.when(F.col("versions") < 2, "Need at least 2 versions for a trend.")
               .when((F.col("breach_risk") == "high") & breach.isNotNull(), F.format_string(
                   "Declining %.1f points per version; below %d by version %d.",
                   F.abs(slope), F.lit(int(sla)), breach))
               .when(F.col("breach_risk") == "high", F.format_string(
                   "Score %.0f is below %d already.", cur, F.lit(int(sla))))
               .when(F.col("breach_risk") == "medium", F.format_string(
                   "Trending down by %.1f points per version.", F.abs(slope)))
               .when(kind == "improving", F.format_string(
                   "Improving by %.1f points per version.", slope))
               .otherwise("Stable."))
    return out.drop("raw_slope", "raw_intercept").withColumn("message", message)


def forecast(trends: DataFrame, points: int = vocab.FORECAST_POINTS) -> DataFrame:
    """dataset_id, version, score: the next versions on the fitted line, within 0 to 100."""
    ahead = trends.where("versions >= 2").select(
        "dataset_id", "slope", "intercept", F.explode(F.sequence(
            F.col("last_version") + 1, F.col("last_version") + points)).alias("version"))
    line = F.col("slope") * F.col("version") + F.col("intercept")
    return ahead.select("dataset_id", "version", F.round(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), line)), 1).alias("score"))
