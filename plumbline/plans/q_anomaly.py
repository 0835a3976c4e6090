"""Anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import anomalies, isolation
from plumbline.operators.cells import number_cells
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table
from plumbline.plans.q_scalar import ORDER_DATES_CTE, order_dates
from plumbline.plans.registry import query

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def fences(cells: str = "nums") -> str:
    return f"""fences AS (SELECT "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lo,
  q3 + 1.5 * (q3 - q1) AS hi, mean, std FROM (SELECT "column", quantile_cont(v, 0.25) AS q1,
  quantile_cont(v, 0.75) AS q3, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS n
  FROM {cells} WHERE v IS NOT NULL GROUP BY 1) WHERE n >= 10)"""


def flag(method: str, condition: str, source: str, value: str = "v") -> str:
    return f"""SELECT "column", {value} AS value, '{method}' AS method, count(*) AS n
  FROM {source} WHERE {condition} GROUP BY 1, 2"""


FENCED = 'nums JOIN fences USING ("column")'
IQR = flag("iqr", "v < lo OR v > hi", FENCED)
ZSCORE = flag("zscore", "std > 0 AND abs((v - mean) / std) > 3", FENCED)


def _numeric(df, method, wanted):
    """Flagged numbers of one method, values as doubles again."""
    return (anomalies.numeric_flags(df, method).where(F.col("method") == wanted)
            .withColumn("value", F.col("value").cast("double")))


@query("impossible_age", f"""{s.people()} SELECT 'age' AS "column", CAST(age AS DOUBLE) AS value,
'impossible_age' AS method, count(*) AS n FROM people WHERE age < 15 OR age > 90 GROUP BY 2""")
def impossible_age(spark, d):
    return _numeric(people(spark, d).select("age"), "iqr", "impossible_age")


@query("sentinel_numbers", f"""{s.people()} SELECT 'quantity' AS "column",
CAST(quantity AS DOUBLE) AS value, 'sentinel_value' AS method, count(*) AS n FROM people
WHERE quantity IN (-1, 0, 999, 9999, -999, 99999) GROUP BY 2""")
def sentinel_numbers(spark, d):
    return _numeric(people(spark, d).select("quantity"), "iqr", "sentinel_value")


@query("fences", f"""WITH {s.numbers(_LINE, 'lineitem')}, {fences()}
SELECT "column", round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 4) AS mean,
       round(std, 4) AS std FROM fences""")
def fence_limits(spark, d):
    return anomalies.fences(table(spark, d, "lineitem").select(*_LINE)).select(
        "column", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"),
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


_SALARY = s.people(s.numbers(("salary", "quantity"), "people"), fences())


@query("iqr_outliers", f"{_SALARY} {IQR}")
def iqr_outliers(spark, d):
    return _numeric(people(spark, d).select("salary", "quantity"), "iqr", "iqr")


@query("zscore_outliers", f"{_SALARY} {ZSCORE}")
def zscore_outliers(spark, d):
    return _numeric(people(spark, d).select("salary", "quantity"), "zscore", "zscore")


_EVENTS = f"WITH {s.numbers(('value', 'user_id'), 'events')}, {fences()}"


@query("iqr_outliers_events", f"{_EVENTS} {IQR}")
def iqr_outliers_events(spark, d):
    return _numeric(table(spark, d, "events").select("value", "user_id"), "iqr", "iqr")


@query("zscore_outliers_events", f"{_EVENTS} {ZSCORE}")
def zscore_outliers_events(spark, d):
    return _numeric(table(spark, d, "events").select("value", "user_id"), "zscore", "zscore")


@query("isolation_forest")
def isolation_forest(spark, d):
    """Flagged values of the event values; about five percent of rows."""
    return anomalies.numeric_flags(table(spark, d, "events").select("value"),
                                   "isolation_forest")


@query("isolation_forest_share")
def isolation_forest_share(spark, d):
    """column, rows, flagged, share: the contamination actually reached."""
    df = table(spark, d, "lineitem").select(*_LINE)
    ranges = isolation.flagged_ranges(df)
    hit = F.coalesce(isolation.in_ranges(F.col("value"), F.col("ranges")), F.lit(False))
    return number_cells(df, list(_LINE)).join(
        F.broadcast(ranges), "column", "left").groupBy("column").agg(
            F.count("*").alias("rows"), F.count_if(hit).alias("flagged"),
            F.avg(hit.cast("double")).alias("share"))


@query("isolation_forest_properties", f"""WITH {s.numbers(_LINE, 'lineitem')} SELECT "column",
  count(*) AS rows, true AS share_fits, true AS repeatable FROM nums GROUP BY 1""")
def isolation_forest_properties(spark, d):
    """About five percent of the rows of spread-out columns, and the same in any partitioning."""
    df = table(spark, d, "lineitem").select(*_LINE)
    ranges = isolation.flagged_ranges(df)
    again = isolation.flagged_ranges(df.repartition(3)).withColumnRenamed("ranges", "again")
    hit = F.coalesce(isolation.in_ranges(F.col("value"), F.col("ranges")), F.lit(False))
    # columns of a few values may have no rare one
    return number_cells(df, list(_LINE)).join(F.broadcast(ranges), "column", "left").join(
        F.broadcast(again), "column", "left").groupBy("column").agg(
        F.count("*").alias("rows"), (F.avg(hit.cast("double")) <= 0.08).alias("share_fits"),
        F.bool_and(F.col("ranges").eqNullSafe(F.col("again"))).alias("repeatable"))


_SPREAD = ("l_orderkey", "l_partkey", "l_extendedprice")


@query("isolation_forest_exact", f"""WITH {s.numbers(_SPREAD, 'lineitem')} SELECT "column",
  count(*) AS rows, true AS share_exact, true AS sparse FROM nums GROUP BY 1""")
def isolation_forest_exact(spark, d):
    """Of columns with many values, five percent of all rows are flagged, and not by far less; the
    flagged ranges hold fewer rows for their width than the column does on the whole."""
    df = table(spark, d, "lineitem").select(*_SPREAD)
    ranges = isolation.flagged_ranges(df)
    v = F.col("value")
    hit = F.coalesce(isolation.in_ranges(v, F.col("ranges")), F.lit(False))
    cells = number_cells(df, list(_SPREAD)).join(F.broadcast(ranges), "column")
    sums = cells.groupBy("column", "ranges").agg(
        F.count("*").alias("rows"), F.count_if(hit).alias("flagged"),
        F.min("value").alias("a"), F.max("value").alias("z"))
    width = F.aggregate("ranges", F.lit(0.0), lambda w, r: w + F.greatest(
        F.lit(0.0), F.least(r["hi"], F.col("z")) - F.greatest(r["lo"], F.col("a"))))
    return sums.select(
        "column", "rows", (F.col("flagged") / F.col("rows")).between(0.035, 0.05).alias(
            "share_exact"), (F.col("flagged") / F.col("rows") <= 1.3 * width / (
                F.col("z") - F.col("a"))).alias("sparse"))


def _text(spark, d, wanted):
    df = people(spark, d)
    return anomalies.text_flags(df, ["signup_date"]).where(
        F.col("method").isin(*wanted)).drop("severity")


_CELLS = s.people(s.cells(s.STRINGS))
INVALID_DATE = (f"NOT {s.ambiguous('signup_date')} AND {s.as_date('signup_date')} IS NULL")
DATE_FLAGS = f"""SELECT 'signup_date' AS "column", {s.strip('signup_date')} AS value,
  CASE WHEN {s.ambiguous('signup_date')} THEN 'ambiguous_date' ELSE 'date_validation' END
    AS method, count(*) AS n FROM people
  WHERE {s.ambiguous('signup_date')} OR ({INVALID_DATE}) GROUP BY 2, 3"""


@query("date_anomalies", f"{s.people()} {DATE_FLAGS}")
def date_anomalies(spark, d):
    return _text(spark, d, ("date_validation", "ambiguous_date"))


@query("date_autodetect", f"""{ORDER_DATES_CTE}
SELECT 'when_text' AS "column", count(*) AS non_null, round(count_if({s.ambiguous('when_text')}
  OR {s.as_date('when_text')} IS NOT NULL) / CAST(count(*) AS DOUBLE), 6) AS date_share
FROM dated""")
def date_autodetect(spark, d):
    return anomalies.date_like_columns(order_dates(spark, d)).withColumn(
        "date_share", F.round("date_share", 6))


RARE = """SELECT "column", value, 'categorical_rarity' AS method, n FROM (
  SELECT "column", v AS value, count(*) AS n, max(count(*)) OVER (PARTITION BY "column") AS mx,
    sum(count(*)) OVER (PARTITION BY "column") AS total,
    count(*) OVER (PARTITION BY "column") AS dist
  FROM rare_cells WHERE v IS NOT NULL GROUP BY 1, 2)
WHERE total >= 10 AND dist <= 0.3 * total AND n <= greatest(0.01 * mx, 1)"""
_RARE_NAMES = ("score_text", "country", "status", "notes")


@query("categorical_rarity",
       f"{s.people(s.cells(_RARE_NAMES, name='rare_cells'))} {RARE}")
def categorical_rarity(spark, d):
    return anomalies.rare_values(people(spark, d), ["signup_date"])


@query("non_numeric_values", f"""{s.people()}
SELECT 'price' AS "column", score_text AS value, 'non_numeric_in_numeric' AS method,
  count(*) AS n FROM people WHERE NOT {s.is_num('score_text')} GROUP BY 2""")
def non_numeric_values(spark, d):
    df = people(spark, d).select(F.col("score_text").alias("price"))
    return anomalies.text_flags(df, []).where(F.col("method") == "non_numeric_in_numeric")


PATTERN = flag("pattern", f"{s.folded('v')} IN {s.values(vocab.JUNK_ANOMALY)}", "cells")
PLACEHOLDER = flag("placeholder_email", f"\"column\" = 'email' AND {s.folded('v')} IN "
                   f"{s.values(vocab.PLACEHOLDER_EMAILS_ANOMALY)}", "cells")


@query("junk_values", f"{_CELLS} {PATTERN}")
def junk_values(spark, d):
    return _text(spark, d, ("pattern",))


@query("placeholder_emails", f"{_CELLS} {PLACEHOLDER}")
def placeholder_emails(spark, d):
    return _text(spark, d, ("placeholder_email",))


@query("long_short_text", """SELECT 'name' AS "column", text AS value, 'text_length' AS method,
count(*) AS n FROM conversations WHERE length(text) > 100 GROUP BY 2""")
def long_short_text(spark, d):
    df = table(spark, d, "conversations").select(F.col("text").alias("name"))
    return anomalies.text_flags(df, []).where(F.col("method") == "text_length")


FLAGGED_CTE = f"""flagged AS (SELECT "column", CAST(value AS VARCHAR) AS value, method, n FROM (
  SELECT 'age' AS "column", CAST(age AS DOUBLE) AS value, 'impossible_age' AS method,
    count(*) AS n FROM people WHERE age < 15 OR age > 90 GROUP BY 2
  UNION ALL SELECT 'quantity', CAST(quantity AS DOUBLE), 'sentinel_value', count(*)
    FROM people WHERE quantity IN (-1, 0, 999, 9999, -999, 99999) GROUP BY 2
  UNION ALL {IQR})
  UNION ALL {DATE_FLAGS} UNION ALL {PATTERN} UNION ALL {PLACEHOLDER} UNION ALL {RARE})"""
ANOMALY_CTES = (s.cells(s.STRINGS), s.numbers(("salary", "quantity"), "people"), fences(),
                s.cells(_RARE_NAMES, name="rare_cells"), FLAGGED_CTE)
_RANK = "CASE method " + " ".join(
    f"WHEN '{m}' THEN {dict(high=3, medium=2, low=1)[sev]}"
    for m, sev in vocab.METHOD_SEVERITY.items()) + " END"
ANOMALIES = f"""anomalies AS (SELECT "column", count(*) AS distinct_values,
  CAST(sum(n) AS BIGINT) AS affected_rows, max(k) AS k FROM (SELECT "column", value,
    max(n) AS n, max({_RANK}) AS k FROM flagged GROUP BY 1, 2) GROUP BY 1)"""
SEVERITY = "CASE k WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


def _flat(found):
    return found.select("column", "distinct_values", "affected_rows",
                        F.array_join("methods_used", ",").alias("methods"), "severity")


_ASSEMBLED = f"""SELECT a."column", distinct_values, affected_rows, (SELECT string_agg(DISTINCT
  method, ',' ORDER BY method) FROM flagged f WHERE f."column" = a."column") AS methods,
  {SEVERITY} AS severity FROM anomalies a"""


@query("anomalies", f"{s.people(*ANOMALY_CTES, ANOMALIES)} {_ASSEMBLED}")
def anomalies_iqr(spark, d):
    return _flat(anomalies.detect(people(spark, d), "iqr"))


@query("anomaly_methods", f"""{s.people(*ANOMALY_CTES)}
SELECT "column", method, count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS rows FROM (
  SELECT * FROM flagged UNION ALL SELECT "column", CAST(value AS VARCHAR), method, n
  FROM ({ZSCORE})) WHERE method <> 'iqr' GROUP BY 1, 2""")
def anomaly_methods(spark, d):
    """The z-score selection: rule hits plus z-scores, no fences."""
    return anomalies.flagged(people(spark, d), "zscore").groupBy("column", "method").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("rows"))


@query("anomaly_page", f"""{s.people(*ANOMALY_CTES, ANOMALIES)} SELECT * FROM ({_ASSEMBLED})
ORDER BY "column" LIMIT 3 OFFSET 3""")
def anomaly_page(spark, d):
    """The second page of three columns."""
    return anomalies.page(_flat(anomalies.detect(people(spark, d), "iqr")), 2, 3)


@query("anomalies_all")
def anomalies_all(spark, d):
    return _flat(anomalies.detect(people(spark, d), "all"))


@query("anomaly_cells", f"""WITH {s.numbers(('value',), 'events')}, {fences()}
SELECT event_id, 'value' AS "column", value, 'iqr' AS method FROM events, fences
WHERE value < lo OR value > hi""")
def anomaly_cells(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    found = anomalies.numeric_flags(df.select("value"), "iqr").withColumn(
        "severity", F.lit("medium"))
    return anomalies.cells(df, found, ["event_id"]).drop("severity").withColumn(
        "value", F.col("value").cast("double"))
