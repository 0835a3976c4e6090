"""Mixed-delimiter check on raw text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import vocab


def _hits(line: Column, d: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))


def delimiter_totals(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per delimiter: position, delimiter, total, dense_lines (>= 2 hits), lines."""
    c = F.col(column)
    aggs = [F.count("*").alias("lines")]
    for d, name in vocab.DELIMITERS:
        aggs += [F.coalesce(F.sum(_hits(c, d)), F.lit(0)).cast("bigint").alias(f"{name}_total"),
                 F.count_if(_hits(c, d) >= 2).alias(f"{name}_dense")]
    return lines.agg(*aggs).select("lines", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("delimiter"),
                 F.col(f"{name}_total").alias("total"),
                 F.col(f"{name}_dense").alias("dense_lines"))
        for i, (_, name) in enumerate(vocab.DELIMITERS, 1)]))).select(
            "position", "delimiter", "total", "dense_lines", "lines")


def _primary() -> Column:
    best = F.max_by("delimiter", F.struct("total", (-F.col("position")).alias("p")))
    return F.when(F.max("total") > 0, best).otherwise("comma")


def primary_delimiter(totals: DataFrame) -> DataFrame:
    """The delimiter with most occurrences; earlier position wins a tie; comma if none."""
    return totals.agg(_primary().alias("primary"))


def delimiter_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row from one pass: primary, mixed, delimiters_found (text), lines_affected, lines.

    lines_affected counts a line once per non-primary delimiter it holds at least twice.
    """
    dense = F.collect_list(F.when(F.col("dense_lines") > 0, F.col("delimiter")))
    all_dense = F.sum("dense_lines")
    best_dense = F.max_by("dense_lines", F.struct("total", (-F.col("position")).alias("p")))
    agg = delimiter_totals(lines, column).agg(
        _primary().alias("primary"), dense.alias("dense"),
        F.when(F.max("total") > 0, all_dense - best_dense).otherwise(0).alias("lines_affected"),
        F.max("lines").alias("lines"))
    found = F.array_sort(F.array_union(F.array("primary"), "dense"))
    return agg.select("primary", (F.col("lines_affected") > 0).alias("mixed"),
                      F.array_join(found, ",").alias("delimiters_found"),
                      F.col("lines_affected").cast("bigint").alias("lines_affected"), "lines")


def affected_lines(lines: DataFrame, key: str, column: str = "value") -> DataFrame:
    """(line key, delimiter, hits) for each non-primary delimiter seen at least twice."""
    c = F.col(column)
    primary = primary_delimiter(delimiter_totals(lines, column)).scalar()
    return (lines.select(key, F.inline(F.array(*[
        F.struct(F.lit(name).alias("delimiter"), _hits(c, d).cast("bigint").alias("hits"))
        for d, name in vocab.DELIMITERS])))
        .where((F.col("hits") >= 2) & (F.col("delimiter") != primary)))


def read_lines(spark: SparkSession, path, limit: int | None = None) -> DataFrame:
    """Raw lines of a text file; limit keeps the first lines only (None: whole file)."""
    lines = spark.read.text(path)
    return lines.limit(limit) if limit else lines
