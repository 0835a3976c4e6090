"""Injection payloads in string cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.functions.text import matched
from plumbline.operators.cells import names_of, tally, weighted_cells
from plumbline.roles import col

VALUE_CHARS, MATCH_CHARS, DISPLAY_ROWS = 200, 80, 100


def _hit(c: Column, threat: str) -> Column:
    if threat == "null_byte":  # a plain byte search, no regex needed
        return c.contains(F.char(F.lit(0)))
    return c.rlike(vocab.THREATS[threat][0])


def findings(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per (row key, column, threat): key..., column, threat_type, severity, value,
    matched_pattern.  Row-local: no shuffle at any size, runs on streams as well."""
    names = [n for n in (columns or names_of(df, "string")) if n not in key]
    entries = []
    for n in names:
        c = col(n)
        for threat, (pattern, severity, _) in vocab.THREATS.items():
            match = F.char(F.lit(0)) if threat == "null_byte" else matched(c, pattern)
            entries.append(F.when(_hit(c, threat), F.struct(
                F.lit(n).alias("column"), F.lit(threat).alias("threat_type"),
                F.lit(severity).alias("severity"),
                c.alias("value"), match.alias("matched_pattern"))))
    hits = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return df.select(*key, F.inline(hits))


def threat_counts(df: DataFrame, columns: list[str] | None = None,
                  repeated: list[str] | None = None) -> DataFrame:
    """column, threat_type, n, severity, weight for every (column, threat) with hits.

    Counting needs no findings: one column-grouped aggregate over the cells.
    """
    names = columns or names_of(df, "string")
    return from_tallies(weighted_cells(df, names, repeated).groupBy("column").agg(*tallies()))


def tallies(where: Column | None = None) -> list[Column]:
    """A count per threat over weighted cells, of those that meet where."""
    v = F.col("value")
    return [tally(_hit(v, t) if where is None else where & _hit(v, t)).alias(t)
            for t in vocab.THREATS]


def from_tallies(counts: DataFrame) -> DataFrame:
    """threat_counts of a frame with a column and its tallies per row."""
    rows = F.array(*[F.struct(F.lit(t).alias("threat_type"), F.col(t).alias("n"),
                              F.lit(sev).alias("severity"), F.lit(w).alias("weight"))
                     for t, (_, sev, w) in vocab.THREATS.items()])
    return counts.select("column", F.inline(rows)).where("n > 0")


def summary(counts: DataFrame) -> DataFrame:
    """threat_type, severity, occurrences, columns (sorted)."""
    return counts.groupBy("threat_type", "severity").agg(
        F.sum("n").alias("occurrences"),
        F.array_sort(F.collect_set("column")).alias("columns"))


def verdict(counts: DataFrame) -> DataFrame:
    """One row: total_threats, has_critical, columns_affected, score_deduction (uncapped,
    once per column and threat)."""
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_threats"),
        F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False))
        .alias("has_critical"),
        F.array_sort(F.collect_set("column")).alias("columns_affected"),
        F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("score_deduction"))


def display(found: DataFrame, key: list[str], n: int = DISPLAY_ROWS) -> DataFrame:
    """The first findings in a fixed order, their texts shortened: for showing only."""
    return found.orderBy(*key, "column", "threat_type").limit(n).withColumns({
        "value": F.substring("value", 1, VALUE_CHARS),
        "matched_pattern": F.substring("matched_pattern", 1, MATCH_CHARS)})
