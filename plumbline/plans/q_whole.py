"""Rules over whole tables, and scores whose parts SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import alerts, cleaning, forecast, profile, repair, root_cause, score
from plumbline.operators.anomalies import numeric_flags
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table, view
from plumbline.plans.q_anomaly import FENCED, IQR, ZSCORE, fences
from plumbline.plans.registry import query
from plumbline.sources import delimiters, readers

_ALL_NULL = " AND ".join(f"{c} IS NULL" for c in s.COLUMNS)


@query("null_rows_table", f"""WITH t AS (SELECT CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END
  AS a, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS b, CASE WHEN o_orderkey % 18 > 0
  THEN o_orderdate END AS c FROM orders) SELECT count_if(a IS NULL AND b IS NULL AND c IS NULL)
  AS null_rows, count(*) AS rows FROM t""")
def null_rows_table(spark, d):
    """Every column of a table of three types."""
    return profile.null_rows(view(spark, d, """SELECT CASE WHEN o_orderkey % 9 > 0 THEN o_custkey
      END AS a, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS b,
      CASE WHEN o_orderkey % 18 > 0 THEN o_orderdate END AS c FROM orders""", "orders"))


@query("null_rows_people", f"""{s.people()}
SELECT count_if({_ALL_NULL}) AS null_rows, count(*) AS rows FROM people""")
def null_rows_people(spark, d):
    return profile.null_rows(people(spark, d))


@query("remaining_issues_table", f"""{s.people(s.cells())}
SELECT * FROM (SELECT 'missing_values' AS issue, "column",
    count(*) - count({s.null_words('v')}) AS count FROM cells GROUP BY 2
  UNION ALL SELECT 'duplicates', '__all__', count(*) - (SELECT count(*) FROM (
    SELECT DISTINCT * FROM people)) FROM people) WHERE count > 0""")
def remaining_issues_table(spark, d):
    return cleaning.remaining_issues(people(spark, d))


_UPPER = ", ".join(f"upper({s.strip(c)}) AS {c}" for c in s.STRINGS)


@query("clean_text_table", f"{s.people()} SELECT * REPLACE ({_UPPER}) FROM people")
def clean_text_table(spark, d):
    """White space and case of all text columns."""
    return cleaning.normalise_text(people(spark, d), "upper")[0]


_NUMBERS = s.people(s.numbers(("salary", "quantity"), "people"), fences())
_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _flags(df, method):
    return (numeric_flags(df, method).where(F.col("method") == method)
            .withColumn("value", F.col("value").cast("double")))


@query("iqr_outliers_table", f"{_NUMBERS} {IQR}")
def iqr_outliers_table(spark, d):
    """All columns given; ages have a rule of their own and ids are not tested."""
    return _flags(people(spark, d), "iqr")


@query("zscore_outliers_table", f"{_NUMBERS} {ZSCORE}")
def zscore_outliers_table(spark, d):
    return _flags(people(spark, d), "zscore")


@query("missing_alerts_table", f"""{s.people(s.cells())}
SELECT "column", CASE WHEN p >= 50 THEN 'critical' ELSE 'high' END AS severity FROM (
  SELECT "column", (count(*) - count(CASE WHEN "column" IN ('phone', 'notes') AND v NOT LIKE '%1%'
    THEN NULL ELSE {s.null_words('v')} END)) * 100.0 / count(*) AS p FROM cells GROUP BY 1)
WHERE p >= 20""")
def missing_alerts_table(spark, d):
    """Every column of a table, two of which were thinned out."""
    df = people(spark, d).withColumns({
        c: F.when(F.col(c).like("%1%"), F.col(c)) for c in ("phone", "notes")})
    return alerts.missing_alerts(profile.missing(df), "people", 1).select(
        F.col("details")["column"].alias("column"), "severity")


_GAPS = s.people(s.cells(), f"""g AS (SELECT "column", count(*) - count({s.null_words('v')}) AS m
  FROM cells GROUP BY 1)""")


@query("fill_values_table", f"""{_GAPS} SELECT "column", CASE
  WHEN "column" = 'age' THEN (SELECT CASE WHEN abs(skewness(age)) > 1 THEN 'median' ELSE 'mean'
    END FROM people) ELSE 'mode' END AS strategy, m AS missing_count FROM g WHERE m > 0""")
def fill_values_table(spark, d):
    df = people(spark, d)
    return root_cause.fill_values(df, profile.missing(df)).select(
        "column", "strategy", "missing_count")


# --- formats and gates -----------------------------------------------------------------------

_FILE = ("concat('part-', o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.JSON' "
         "WHEN 2 THEN '.parquet' WHEN 3 THEN '.xlsx' WHEN 4 THEN '' ELSE '.csv.gz' END)")


@query("refused_formats", f"""SELECT {_FILE} AS path, CASE o_orderkey % 6 WHEN 0 THEN 'csv'
  WHEN 1 THEN 'json' WHEN 2 THEN 'parquet' WHEN 3 THEN 'xlsx' WHEN 4 THEN '' ELSE 'gz' END
  AS format, o_orderkey % 6 < 3 AS accepted FROM orders""")
def refused_formats(spark, d):
    """Which of many files the readers take."""
    files = table(spark, d, "orders").selectExpr(f"{_FILE} AS path")
    return readers.accepted_formats(files)


@query("suggestions_gate", """SELECT score > 80 AS above, CASE WHEN score > 80 THEN 0 ELSE n END
  AS suggestions FROM (SELECT unnest([79.9, 80.0, 80.1, 95.0]) AS score), (
  SELECT 3 AS n FROM orders LIMIT 1)""")
def suggestions_gate(spark, d):
    """Suggestions for one table under four scores: none above the gate."""
    df = view(spark, d, """SELECT concat('order ', o_orderkey) AS label,
      CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_orderpriority END AS level FROM orders
      UNION ALL SELECT concat('order ', o_orderkey), CASE WHEN o_orderkey % 4 < 2 THEN NULL
      ELSE o_orderpriority END FROM orders WHERE o_orderkey % 4 = 1""", "orders")
    out = None
    for value in (79.9, 80.0, 80.1, 95.0):
        part = repair.gated(df, value).agg(F.count("*").alias("suggestions")).select(
            F.lit(value > vocab.CLEANING_GATE).alias("above"),
            F.col("suggestions").cast("int").alias("suggestions"))
        out = part if out is None else out.unionByName(part)
    return out


# --- scores in full --------------------------------------------------------------------------

#: A table with two defects, missing cells and repeated rows, and nothing else.
_TWO = ("SELECT concat('order ', o_orderkey) AS label, CASE WHEN o_orderkey % 4 < {gap} THEN NULL "
        "ELSE o_orderpriority END AS level FROM orders UNION ALL SELECT concat('order ', "
        "o_orderkey), CASE WHEN o_orderkey % 4 < {gap} THEN NULL ELSE o_orderpriority END "
        "FROM orders WHERE o_orderkey % 4 = 1")


def _scored(name: str, source: str, extra: str = "0") -> str:
    """CTE: rows, distinct rows and the score of a table whose cells may be missing and rows
    repeated; extra: further points."""
    return f"""{name}_m AS (SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT *
    FROM {source})) AS kept, (count(*) - count(level)) * 100.0 / (2 * count(*)) AS p
    FROM {source}), {name}_d AS (SELECT rows, kept, round(least(pow(p, 1.2) * 0.35, 35.0)
    + least(pow((rows - kept) * 100.0 / rows, 1.2) * 0.6, 15.0) + {extra}, 2) AS total
    FROM {name}_m), {name} AS (SELECT rows, kept, round(CASE WHEN total < 5
    THEN least(100 - total, 95.0) WHEN total < 15 THEN least(100 - total, 88.0)
    ELSE 100 - total END, 2) AS score FROM {name}_d)"""


def _grade(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} >= {least} THEN '{letter}'"
                              for letter, least in vocab.GRADES) + " ELSE 'F' END"


_CLEANED = (f"WITH two AS ({_TWO.format(gap=2)}), {_scored('b', 'two')}, "
            "r AS (SELECT b.rows AS rows_before, b.kept AS rows_after, b.score AS score_before, "
            "95.0::DOUBLE AS score_after FROM b)")


@query("cleaning_report_scores", f"""{_CLEANED} SELECT rows_before, rows_after,
  CAST(score_before AS DOUBLE) AS score_before, score_after, false AS skipped,
  CAST(round(score_after - score_before, 2) AS DOUBLE) AS score_delta,
  {_grade('score_before')} AS grade_before, {_grade('score_after')} AS grade_after,
  CAST(round(round(score_after - score_before, 2) * 100.0 / score_before, 1) AS DOUBLE)
    AS improvement_pct FROM r""")
def cleaning_report_scores(spark, d):
    """The whole report of a table below the gate."""
    return cleaning.clean(view(spark, d, _TWO.format(gap=2), "orders")).report


@query("step_scores", f"""{_CLEANED}, f AS (SELECT label, coalesce(level, 'x') AS level FROM two),
{_scored('a', 'f')} SELECT * FROM (SELECT 1::BIGINT AS position, 'fill_categorical' AS key,
  CAST(r.score_before AS DOUBLE) AS score_before, CAST(a.score AS DOUBLE) AS score_after,
  CAST(round(a.score - r.score_before, 2) AS DOUBLE) AS score_gain FROM r, a
UNION ALL SELECT 2, 'remove_duplicates', CAST(a.score AS DOUBLE), score_after,
  CAST(round(score_after - a.score, 2) AS DOUBLE) FROM r, a)""")
def step_scores(spark, d):
    """The score after every step that changed something."""
    done = cleaning.clean(view(spark, d, _TWO.format(gap=2), "orders"),
                          cleaning.Options(score_each_step=True))
    return done.steps.select("position", "key", "score_before", "score_after", "score_gain")


@query("cleaning_gate", """SELECT count(*) AS rows_before, count(*) AS rows_after,
  true AS skipped, true AS unchanged FROM orders""")
def cleaning_gate(spark, d):
    """A table above the gate is returned as it is."""
    df = view(spark, d, "SELECT concat('order ', o_orderkey) AS label, o_orderpriority AS level "
              "FROM orders", "orders")
    done = cleaning.clean(df)
    return done.report.select("rows_before", "rows_after", "skipped", (
        (F.col("score_before") == F.col("score_after")) & F.lit(done.table is df)).alias(
            "unchanged"))


_VERSIONS = (2, 1, 3)
_HISTORY = ", ".join(f"v{i} AS ({_TWO.format(gap=g)}), {_scored(f's{i}', f'v{i}')}"
                     for i, g in enumerate(_VERSIONS, 1))


@query("score_history_versions", f"WITH {_HISTORY} " + " UNION ALL ".join(
    f"SELECT 'orders' AS dataset_id, {i}::BIGINT AS version, CAST(score AS DOUBLE) AS score "
    f"FROM s{i}" for i in range(1, len(_VERSIONS) + 1)))
def score_history_versions(spark, d):
    """Three versions of a table, scored."""
    return forecast.history({("orders", i): view(spark, d, _TWO.format(gap=g), "orders")
                             for i, g in enumerate(_VERSIONS, 1)})


@query("score_mixed_delimiters", f"""WITH two AS ({_TWO.format(gap=2)}), {_scored('b', 'two', '15 + 5')}
SELECT CAST(score AS DOUBLE) AS score FROM b""")
def score_mixed_delimiters(spark, d):
    """Mixed delimiters in the source cost points, and more as a third dimension that fails."""
    lines = table(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderkey % 50 = 7 THEN concat(o_orderkey, ';', o_orderstatus, ';x') ELSE "
        "concat(o_orderkey, ',', o_custkey, ',', o_orderstatus) END AS value")
    return score.score(view(spark, d, _TWO.format(gap=2), "orders"),
                       delimiters=delimiters.delimiter_report(lines)).quality.select("score")
