"""Anomalous values per column.

Whether a cell is anomalous depends on its column and value only, so flagged cells are
counted per (column, value) at once and every later step works on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import dates, text
from plumbline.operators import isolation
from plumbline.operators.cells import (
    distinct_estimates, histogram, in_columns, number_cells, often_repeated, pin, small_frame,
    tally, text_cells, together, weighted_cells)
from plumbline.operators.profile import numeric_stats
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans.session import checkpointed
from plumbline.roles import col

METHODS = ("iqr", "zscore", "isolation_forest", "all")
PAGE_LIMIT = 200
BROADCAST_VALUES = 100_000
_FLAGGED = "column string, value string, method string, n bigint"


def _names(df: DataFrame, kind: str, role: str | None = None) -> list[str]:
    """Columns under test: everything except ids."""
    return [c.name for c in roles.columns(df) if c.kind == kind and not c.has("id")
            and (role is None or c.has(role))]


def _severity(method: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.METHOD_SEVERITY.items() for x in kv])
    return F.try_element_at(table, method)


def _rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def fences(df: DataFrame, names: list[str] | None = None,
           moments: DataFrame | None = None) -> DataFrame:
    """column, n, q1, q3, lo, hi, mean, std for numeric columns with enough observations.

    moments: pinned column, n, mean, std if already known.
    """
    names = names if names is not None else _names(df, "numeric")
    if moments is None:
        moments = pin(numeric_stats(df, names))
    moments = moments.select("column", "n", "mean", "std").where(F.col("column").isin(*names))
    counts = {r["column"]: r["n"] for r in moments.collect()}
    q = exact_quantiles(df, names, (0.25, 0.75), counts=counts).select(
        "column", F.col("q_25").alias("q1"), F.col("q_75").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return (moments.join(q, "column")
            .where(F.col("n") >= vocab.MIN_OBSERVATIONS)
            .withColumn("lo", F.col("q1") - vocab.IQR_FACTOR * iqr)
            .withColumn("hi", F.col("q3") + vocab.IQR_FACTOR * iqr))


def _collect_methods(flags: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in flags.items()]),
                    lambda m: m.isNotNull())


def _flag(cells: DataFrame, flags: dict[str, Column], shown: Column) -> DataFrame:
    """Rows (column, value, method, n) for cells (weighted or not) with at least one method."""
    if "n" not in cells.columns:  # unweighted: every cell counts once
        cells = cells.withColumn("n", F.lit(1).cast("bigint"))
    hit = cells.withColumn("methods", _collect_methods(flags)).where(F.size("methods") > 0)
    return (hit.select("column", shown.alias("value"), "methods", "n")
            .groupBy("column", "value", "methods").agg(F.sum("n").alias("n"))
            .select("column", "value", F.explode("methods").alias("method"), "n"))


def numeric_flags(df: DataFrame, method: str = "all",
                  moments: DataFrame | None = None) -> DataFrame:
    """Flagged values of numeric columns: impossible ages, sentinels and outliers."""
    empty = small_frame(df.sparkSession, [], _FLAGGED)
    names = _names(df, "numeric")
    if not names:
        return empty
    ages = _names(df, "numeric", "age")
    rest = [n for n in names if n not in ages]
    v = F.col("value")
    out = empty
    if ages:
        lo, hi = vocab.AGE_RANGE
        out = out.unionByName(_flag(number_cells(df, ages), {
            "impossible_age": (v < lo) | (v > hi)}, v.cast("string")))
    if not rest:
        return out
    forest = method in ("isolation_forest", "all")
    least = vocab.FOREST_MIN_OBSERVATIONS if method == "all" else vocab.MIN_OBSERVATIONS
    # one row per column each
    limits, ranges = together(
        lambda: pin(fences(df, rest, moments)),
        lambda: pin(isolation.flagged_ranges(df, rest, min_rows=least)) if forest else None)
    cells = (number_cells(df, rest).where(v.isNotNull())
             .join(F.broadcast(limits.drop("n")), "column", "left"))
    flags = {"sentinel_value": in_columns(_names(df, "numeric", "sentinel"))
             & v.isin(*[float(x) for x in vocab.SENTINEL_NUMERIC])}
    if method in ("iqr", "all"):
        flags["iqr"] = (v < F.col("lo")) | (v > F.col("hi"))
    if method in ("zscore", "all"):
        flags["zscore"] = (F.col("std") > 0) & (
            F.abs((v - F.col("mean")) / F.col("std")) > vocab.Z_THRESHOLD)
    if forest:
        cells = cells.join(F.broadcast(ranges), "column", "left")
        flags["isolation_forest"] = F.coalesce(
            isolation.in_ranges(v, F.col("ranges")), F.lit(False))
    return out.unionByName(_flag(cells, flags, v.cast("string")))


def date_like_columns(df: DataFrame) -> DataFrame:
    """column, non_null, date_share for string columns not named as dates.

    The shapes of dates keep the parser away from free text.
    """
    names = [c.name for c in roles.columns(df)
             if c.kind == "string" and not c.has("id") and not c.has("date")]
    v = F.col("value")
    like = dates.is_ambiguous(v) | dates.as_date(v).isNotNull()
    return (weighted_cells(df, names).groupBy("column").agg(
        tally(v.isNotNull()).alias("non_null"), tally(like).alias("dates"))
        .where(F.col("non_null") > 0)
        .select("column", "non_null", (F.col("dates") / F.col("non_null")).alias("date_share")))


def text_flags(df: DataFrame, date_columns: list[str], repeated: list[str] | None = None,
               only: list[str] | None = None) -> DataFrame:
    """Flagged values of string columns, rarity excepted.  only: the columns known to have some."""
    names = [n for n in _names(df, "string") if only is None or n in only]
    if not names:
        return small_frame(df.sparkSession, [], _FLAGGED)
    v = F.col("value")
    is_date = in_columns(date_columns)
    s = text.strip(v)
    f = F.lower(s)
    ambiguous = is_date & s.rlike(vocab.AMBIGUOUS_DATE)
    flags = {
        "date_validation": is_date & ~s.rlike(vocab.AMBIGUOUS_DATE) & dates.as_date(v).isNull(),
        "ambiguous_date": ambiguous,
        "non_numeric_in_numeric": in_columns(_names(df, "string", "numeric_intent"))
        & ~text.is_num(v) & ~f.isin("", "nan"),
        "pattern": f.isin(*vocab.JUNK_ANOMALY),
        "placeholder_email": in_columns(_names(df, "string", "email"))
        & f.isin(*vocab.PLACEHOLDER_EMAILS_ANOMALY),
        "text_length": in_columns(_names(df, "string", "short_text"))
        & (F.length(v) > vocab.SHORT_TEXT_LIMIT),
    }
    cells = weighted_cells(df, names, repeated).where(v.isNotNull())
    return _flag(cells, flags, F.when(is_date, s).otherwise(v))


def rare_values(df: DataFrame, date_columns: list[str],
                estimates: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Values far rarer than the column's most frequent one.

    Columns whose estimated distinct share is clearly above the limit are dropped before
    any value is shuffled; the rest are decided on exact counts.  estimates:
    cells.distinct_estimates if known.
    """
    skip = set(date_columns)
    names = [c.name for c in roles.columns(df)
             if (c.kind == "string" or c.dtype.typeName() == "boolean")
             and not c.has("id") and not c.has("identity") and c.name not in skip]
    if not names:
        return small_frame(df.sparkSession, [], _FLAGGED)
    if estimates is None:
        estimates = distinct_estimates(df, names)
    keep = [c for c in names if estimates[c][1] >= vocab.MIN_OBSERVATIONS
            and estimates[c][2] <= 2 * vocab.MAX_CARDINALITY_RATIO * estimates[c][1]]
    hist = histogram(text_cells(df, keep))
    per_column = hist.groupBy("column").agg(
        F.sum("n").alias("non_null"), F.count("*").alias("d"), F.max("n").alias("max_n"))
    return (hist.join(F.broadcast(per_column), "column")  # one row per column
            .where((F.col("non_null") >= vocab.MIN_OBSERVATIONS)
                   & (F.col("d") <= vocab.MAX_CARDINALITY_RATIO * F.col("non_null"))
                   & (F.col("n") <= F.greatest(F.col("max_n") * vocab.RARE_RATIO, F.lit(1.0))))
            .select("column", "value", F.lit("categorical_rarity").alias("method"), "n"))


def flagged(df: DataFrame, method: str = "all", as_dates: list[str] | None = None,
            moments: DataFrame | None = None,
            estimates: dict[str, tuple[int, int, int]] | None = None,
            only: list[str] | None = None) -> DataFrame:
    """column, value, method, severity, n: every anomalous value with its row count.

    as_dates (facts.date_columns), moments (facts.number_facts), estimates
    (cells.distinct_estimates) and only (facts.flagged_columns) may be passed in when they were
    measured before.
    """
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method '{method}'; use one of {', '.join(METHODS)}")
    if as_dates is None:
        as_dates = date_columns(df)
    repeated = None if estimates is None else often_repeated(estimates)
    parts = together(lambda: numeric_flags(df, method, moments),
                     lambda: text_flags(df, as_dates, repeated, only),
                     lambda: rare_values(df, as_dates, estimates))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("severity", _severity(F.col("method")))


def date_columns(df: DataFrame) -> list[str]:
    """String columns treated as dates: by name, or because most cells look like dates."""
    auto = date_like_columns(df).where(F.col("date_share") >= vocab.DATE_LIKE_SHARE)
    return _names(df, "string", "date") + [r["column"] for r in auto.collect()]


def assemble(found: DataFrame, limit: int = vocab.ANOMALY_LIST_LIMIT) -> DataFrame:
    """One row per column: distinct_values, affected_rows, anomalies (at most limit, for
    showing), methods_used, severity."""
    values = found.groupBy("column", "value").agg(
        F.max("n").alias("n"), F.collect_set("method").alias("methods"),
        F.max(_rank(F.col("severity"))).alias("rank"))
    w = Window.partitionBy("column").orderBy("value")
    shown = (values.withColumn("i", F.row_number().over(w)).where(F.col("i") <= limit)
             .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("anomalies")))
    total = values.groupBy("column").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("affected_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("methods_used"),
        F.max("rank").alias("rank"))
    return total.join(shown, "column").select(
        "column", "distinct_values", "affected_rows", "anomalies", "methods_used",
        F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium")
        .otherwise("low").alias("severity"))


def detect(df: DataFrame, method: str = "all", as_dates: list[str] | None = None,
           moments: DataFrame | None = None,
           estimates: dict[str, tuple[int, int, int]] | None = None,
           only: list[str] | None = None) -> DataFrame:
    """Anomalous columns of df, assembled."""
    return assemble(flagged(df, method, as_dates, moments, estimates, only))


def cells(df: DataFrame, found: DataFrame, key: list[str],
          as_dates: list[str] | None = None) -> DataFrame:
    """Row-level view: key..., column, value, method, severity of every flagged cell.

    as_dates: the columns taken as dates when found was made; their values are compared
    without white space around them, as flagged() lists them.
    """
    if as_dates is None:
        as_dates = date_columns(df)
    names = [c.name for c in roles.columns(df) if c.name not in key]

    def shown(n):
        c = col(n)
        if roles.is_numeric(df.schema[n].dataType):
            return c.cast("double").cast("string")
        return text.strip(c) if n in as_dates else c.cast("string")
    pairs = [x for n in names for x in (F.lit(n), shown(n))]
    tall = df.select(*key, F.stack(F.lit(len(names)), *pairs).alias("column", "value"))
    # a flagged value may be in a third of all rows: unless there are very many flagged values,
    # they go to the cells, not the cells to them
    found = checkpointed(found.drop("n"))
    if found.count() <= BROADCAST_VALUES:
        found = F.broadcast(found)
    return tall.join(found, ["column", "value"]).select(
        *key, "column", "value", "method", "severity")


def page(results: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Page of a per-column result, ordered by column; pages above PAGE_LIMIT are refused."""
    if not 1 <= size <= PAGE_LIMIT or number < 1:
        raise ValueError(f"page {number} of size {size}: sizes go from 1 to {PAGE_LIMIT}")
    return results.orderBy("column").offset((number - 1) * size).limit(size)
