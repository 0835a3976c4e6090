"""Statistical drift between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import stats
from plumbline.operators import ks
from plumbline.operators.cells import number_cells, pin, small_frame, text_cells, together
from plumbline.operators.frequent import KEY, PREFIX, hashed
from plumbline.operators.profile import normalised

_TESTED = ("column string, drift_type string, test string, statistic double, p_value double, "
           "mean_a double, mean_b double, mean_shift double, std_shift double")


def common_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric on both sides, other) columns both versions have."""
    kb = {c.name: c.kind for c in roles.columns(b)}
    numeric, other = [], []
    for c in roles.columns(a):
        if c.name in kb:
            both = c.kind == "numeric" and kb[c.name] == "numeric"
            (numeric if both else other).append(c.name)
    return numeric, other


def _tagged(cells, a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    return (cells(normalised(a), names).withColumn("side", F.lit("a"))
            .unionByName(cells(normalised(b), names).withColumn("side", F.lit("b")))
            .where(F.col("value").isNotNull()))


def paired_histogram(cells, a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n_a, n_b) with one shuffle for both versions."""
    side = F.col("side")
    return _tagged(cells, a, b, names).groupBy("column", "value").agg(
        F.count_if(side == "a").alias("n_a"), F.count_if(side == "b").alias("n_b"))


def paired_hashes(a: DataFrame, b: DataFrame, names: list[str], width: int = PREFIX) -> DataFrame:
    """(column, h1, h2, prefix, n_a, n_b): the histograms of both versions beside each other by
    the hashes of their values, so that no value longer than width is exchanged."""
    side = F.col("side")
    return hashed(_tagged(text_cells, a, b, names), width, "side").groupBy(*KEY, "prefix").agg(
        F.count_if(side == "a").alias("n_a"), F.count_if(side == "b").alias("n_b"))


def numeric_moments(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """column, n_a, n_b, mean_a, mean_b, std_a, std_b, min_a ... max_b."""
    v, out = F.col("value"), []
    for s in ("a", "b"):
        x = F.when(F.col("side") == s, v)
        out += [F.count(x).alias(f"n_{s}"), F.avg(x).alias(f"mean_{s}"),
                F.stddev_samp(x).alias(f"std_{s}"), F.min(x).alias(f"min_{s}"),
                F.max(x).alias(f"max_{s}")]
    return _tagged(number_cells, a, b, names).groupBy("column").agg(*out)


def ks_statistics(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """column, n_a, n_b, statistic: largest gap between the two distribution functions."""
    rows = ks.statistics(_tagged(number_cells, a, b, names), names, vocab.DRIFT_MIN_ROWS)
    return small_frame(a.sparkSession, rows,
                       "column string, n_a bigint, n_b bigint, statistic double")


def chi2_statistics(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """column, n_a, n_b, categories, statistic.

    Observed counts come from a, expected ones from b scaled to a's total.  With
    e = (n_b + eps) * scale the sum of (o - e)^2 / e needs only sums over the histogram,
    so every column reduces map-side.
    """
    eps = 1e-9
    hist = paired_hashes(a, b, names)
    o, x = F.col("n_a") + eps, F.col("n_b") + eps
    sums = hist.groupBy("column").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"),
        F.count("*").alias("categories"), F.sum(o).alias("so"), F.sum(x).alias("sx"),
        F.sum(o * o / x).alias("ratio"))
    # sum((o - e)^2 / e) with e = x * so / sx equals sum(o^2 / x) * sx / so - so
    stat = F.col("ratio") * F.col("sx") / F.col("so") - F.col("so")
    return (sums.where((F.col("n_a") >= vocab.DRIFT_MIN_ROWS)
                       & (F.col("n_b") >= vocab.DRIFT_MIN_ROWS))
            .select("column", "n_a", "n_b", "categories",
                    F.greatest(stat, F.lit(0.0)).alias("statistic")))


def severity(p):
    return F.when(p < 0.01, "high").when(p < vocab.DRIFT_P_VALUE, "medium").otherwise("low")


def detect(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per tested column: drift_type, test, statistic, p_value, is_drifted, severity,
    mean_a, mean_b, mean_shift, std_shift, interpretation."""
    numeric, other = common_columns(a, b)
    gaps, mom, chi = together(
        lambda: ks_statistics(a, b, numeric) if numeric else None,
        lambda: pin(numeric_moments(a, b, numeric)) if numeric else None,
        lambda: pin(chi2_statistics(a, b, other)) if other else None)
    parts = []
    if gaps is not None:
        parts.append(gaps.join(mom.drop("n_a", "n_b"), "column").select(
            "column", F.lit("numerical").alias("drift_type"), F.lit("ks_test").alias("test"),
            "statistic",
            stats.ks_pvalue(F.col("statistic"), F.col("n_a"), F.col("n_b")).alias("p_value"),
            "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("mean_shift"),
            (F.col("std_b") - F.col("std_a")).alias("std_shift")))
    if chi is not None:
        null = F.lit(None).cast("double")
        parts.append(chi.select(
            "column", F.lit("categorical").alias("drift_type"), F.lit("chi2_test").alias("test"),
            "statistic", F.coalesce(F.nanvl(stats.chi2_pvalue(
                F.col("statistic"), (F.col("categories") - 1).cast("double")), F.lit(1.0)),
                F.lit(1.0)).alias("p_value"),
            null.alias("mean_a"), null.alias("mean_b"), null.alias("mean_shift"),
            null.alias("std_shift")))
    if not parts:  # nothing to compare
        parts.append(small_frame(a.sparkSession, [], _TESTED))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    p = F.col("p_value")
    return out.withColumn("is_drifted", p < vocab.DRIFT_P_VALUE).withColumn(
        "severity", severity(p)).withColumn(
        "interpretation", F.when(F.col("is_drifted"), F.format_string(
            "distribution changed (statistic %.4f, p %.4f)", "statistic", "p_value"))
        .otherwise(F.format_string("stable (p %.4f)", "p_value")))


def summary(drift: DataFrame) -> DataFrame:
    """One row: drifted, stable (counts) and their sorted column names."""
    d = F.col("is_drifted")
    return drift.agg(
        F.count_if(d).alias("drifted"), F.count_if(~d).alias("stable"),
        F.array_sort(F.collect_list(F.when(d, F.col("column")))).alias("drifted_columns"),
        F.array_sort(F.collect_list(F.when(~d, F.col("column")))).alias("stable_columns"))


def between_versions(a: DataFrame, version_a: int, b: DataFrame, version_b: int) -> DataFrame:
    """Like detect; a version compared with itself is answered without any job."""
    if version_a == version_b:
        numeric, other = common_columns(a, b)
        rows = a.sparkSession.createDataFrame(
            [(c, "numerical" if c in numeric else "categorical") for c in numeric + other],
            "column string, drift_type string")
        zero = F.lit(0.0)
        return rows.select("column", "drift_type", F.lit("identical").alias("test"),
                           zero.alias("statistic"), F.lit(1.0).alias("p_value"),
                           F.lit(False).alias("is_drifted"), F.lit("low").alias("severity"))
    return detect(a, b).select("column", "drift_type", "test", "statistic", "p_value",
                               "is_drifted", "severity")
