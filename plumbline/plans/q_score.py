"""Score, report and flagship queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import (
    alerts, anomalies, drift, forecast, pii, report, score, security)
from plumbline.operators.cells import pin
from plumbline.plans import q_anomaly as qa
from plumbline.plans import q_compare, q_ingest
from plumbline.plans import q_scan as qs
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, people_v2, table
from plumbline.plans.registry import query
from plumbline.sources import delimiters

AS_OF = dt.date(2025, 1, 1)
CONFIG = score.ScoreConfig(method="iqr", as_of=AS_OF)
PLAIN = score.ScoreConfig(method="iqr", as_of=AS_OF, with_security=False, with_pii=False)


def _pct(n, of):
    return f"(({n}) * 100.0 / ({of}))"


_GAPS = f"""gaps AS (SELECT "column", count(*) - count({s.null_words('v')}) AS m, count(*) AS r
  FROM cells GROUP BY 1)"""
_MISS = _pct("sum(m)", "sum(r)")
_D = s.as_date("signup_date")
_BAD_DATE = f"""NOT {s.ambiguous('signup_date')} AND ({_D} IS NULL OR year({_D}) < 1900
  OR year({_D}) > 2026 OR {_D} > DATE '2025-01-01')"""
_BAD_MAIL = f"NOT {s.match(s.strip('email'), vocab.EMAIL_STRICT)}"
_DUP = """(SELECT count(*) FROM people) - (SELECT count(*) FROM (SELECT DISTINCT * FROM people))"""
_GARBAGE = f"(SELECT count_if({s.folded('v')} IN {s.values(vocab.GARBAGE)}) FROM text_cells)"
_STAND_IN = (f"(SELECT count_if({s.folded('email')} IN "
             f"{s.values(vocab.PLACEHOLDER_EMAILS_SCORE)}) + count_if({s.strip('signup_date')} "
             f"IN {s.values(vocab.PLACEHOLDER_DATES)}) FROM people)")
_MIXED = f"count_if(NOT {s.is_num('score_text')})"


def _by(severity):
    return (f"coalesce(sum(least(distinct_values, 50)) FILTER (WHERE {qa.SEVERITY} = "
            f"'{severity}'), 0)")


_RAW_ANOMALY = f"({_by('high')} * 3 + {_by('medium')} * 0.8 + {_by('low')} * 0.2)"


def base_cte(security: bool = True, delimiters: bool = False) -> str:
    """Penalties before compounding: dimension, impact, deduction, columns."""
    parts = [
        f"""SELECT 'completeness' AS dimension, CASE WHEN {_MISS} >= 20 THEN 'high'
          WHEN {_MISS} >= 5 THEN 'medium' ELSE 'low' END AS impact,
          least(power({_MISS}, 1.2) * 0.35, 35) AS deduction, string_agg("column", ','
            ORDER BY "column") FILTER (WHERE m > 0) AS columns FROM gaps""",
        """SELECT 'validity', 'high', least(count_if(age < 15 OR age > 90) * 2, 15), 'age'
          FROM people""",
        f"""SELECT 'validity', CASE WHEN {_pct(f'count_if({_BAD_MAIL})', 'count(email)')} >= 50
          THEN 'high' ELSE 'medium' END,
          least({_pct(f'count_if({_BAD_MAIL})', 'count(email)')} * 0.5, 10), 'email' FROM people""",
        f"""SELECT 'validity', CASE WHEN count_if({_BAD_DATE}) < 5 THEN 'medium' ELSE 'high' END,
          least(count_if({_BAD_DATE}) * 2, 10), 'signup_date' FROM people""",
        f"""SELECT 'validity', 'high', CASE WHEN {_MIXED} >= 2 AND {_MIXED} <= 0.3 * count(
          score_text) THEN least(power({_pct(_MIXED, 'count(score_text)')}, 1.2) * 0.4, 8)
          ELSE 0 END, 'score_text' FROM people""",
        f"""SELECT 'consistency', CASE WHEN k > 2 THEN 'high' ELSE 'medium' END,
          CASE WHEN k >= 2 THEN 6 ELSE 0 END, 'signup_date' FROM (SELECT count(DISTINCT
          {s.label('signup_date', vocab.DATE_LABELS_SCORE)}) AS k FROM people)""",
        f"""SELECT 'consistency', 'low', CASE WHEN count(DISTINCT status) >
          count(DISTINCT {s.folded('status')}) THEN 3 ELSE 0 END, 'status' FROM people""",
        f"""SELECT 'uniqueness', CASE WHEN p >= 10 THEN 'high' WHEN p >= 2 THEN 'medium'
          ELSE 'low' END, least(power(p, 1.2) * 0.6, 15), '' FROM (SELECT {_pct(_DUP,
          '(SELECT count(*) FROM people)')} AS p)""",
        f"""SELECT 'garbage', CASE WHEN p >= 2 THEN 'medium' ELSE 'low' END,
          least(power(p, 1.2) * 1.5, 12), '' FROM (SELECT {_pct(_GARBAGE,
          '(SELECT count(*) FROM cells)')} AS p)""",
        f"SELECT 'garbage', 'low', least({_STAND_IN} * 2, 5), ''",
        f"""SELECT 'anomalies', CASE WHEN {_by('high')} > 0 THEN 'high' WHEN {_by('medium')} > 0
          THEN 'medium' ELSE 'low' END, least({_RAW_ANOMALY}, 15),
          string_agg("column", ',' ORDER BY "column") FROM anomalies"""]
    if security:
        parts += [
            """SELECT 'security', 'high', sum(n) * 5, string_agg("column", ',' ORDER BY "column")
              FROM threats GROUP BY threat_type""",
            """SELECT 'security', CASE WHEN count_if(confidence = 'high') >= 1 OR
              count_if(confidence = 'medium') >= 2 THEN 'high' ELSE 'low' END,
              5 + 3 * count(*), string_agg("column", ',' ORDER BY "column") FROM pii_columns"""]
    if delimiters:
        parts.append("SELECT 'consistency', 'high', 15, ''")
    union = " UNION ALL ".join(parts)
    return (f"pen AS (SELECT dimension, impact, CAST(deduction AS DOUBLE) AS deduction, columns "
            f"FROM ({union}) WHERE deduction > 0)")


_CAPS = "CASE dimension " + " ".join(
    f"WHEN '{d}' THEN {cap}" for d, (cap, _, _) in vocab.DIMENSIONS.items() if cap) + " END"
_DIMS = " UNION ALL ".join(f"SELECT '{d}' AS dimension" for d in vocab.DIMENSIONS)
_POINTS = f"""points AS (SELECT dimension, least(coalesce(sum(deduction), 0),
  coalesce({_CAPS}, 1e9)) AS deducted FROM ({_DIMS}) LEFT JOIN pen USING (dimension)
  GROUP BY 1)"""
_COMP = """comp AS (SELECT count(*) AS failing, CASE WHEN count(*) >= 3 THEN (count(*) - 2) * 5.0
  ELSE 0 END AS deduction FROM points WHERE dimension <> 'security' AND deducted > 3)"""
_COMMON = (s.cells(), s.cells(s.STRINGS, name="text_cells"), _GAPS)
_ANOM = tuple(c.replace("FROM cells", "FROM text_cells") for c in qa.ANOMALY_CTES
              if not c.startswith("cells AS")) + (qa.ANOMALIES,)
_SEC = (qs._counts_cte("text_cells"), qs.PII_COUNTS, qs.PII_COLUMNS)
CTES = _COMMON + _ANOM + _SEC + (base_cte(), _POINTS, _COMP)
PLAIN_CTES = _COMMON + _ANOM + (base_cte(security=False), _POINTS, _COMP)


def _scored(spark, d, config=CONFIG):
    return score.score(people(spark, d), config)


@query("penalties", f"""{s.people(*CTES)}
SELECT dimension, impact, round(deduction, 2) AS deduction, columns FROM pen
UNION ALL SELECT 'compounding', 'high', round(deduction, 2), '' FROM comp WHERE deduction > 0""")
def penalties(spark, d):
    return _scored(spark, d).penalties.select(
        "dimension", "impact", "deduction",
        F.array_join("affected_columns", ",").alias("columns"))


_DIV = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {div}" for d, (_, div, w) in
                                    vocab.DIMENSIONS.items() if w) + " END"
_WEIGHT = "CASE dimension " + " ".join(f"WHEN '{d}' THEN CAST({w} AS DOUBLE)" for d, (_, _, w) in
                                       vocab.DIMENSIONS.items() if w) + " END"


@query("dimension_scores", f"""{s.people(*PLAIN_CTES)}
SELECT dimension, round(deducted, 2) AS deducted, score, weight, round(score * weight, 2)
  AS weighted FROM (SELECT dimension, deducted, {_WEIGHT} AS weight, greatest(round(100 - least(
  deducted / {_DIV} * 100, 100), 1), 0) AS score FROM points WHERE dimension <> 'anomalies')""")
def dimension_scores(spark, d):
    return _scored(spark, d, PLAIN).dimensions


_LEGACY = "CASE dimension " + " ".join(f"WHEN '{d}' THEN CAST({p} AS DOUBLE)" for d, p in
                                       vocab.LEGACY_POINTS.items()) + " END"


@query("score_breakdown", f"""{s.people(*CTES)}
SELECT dimension, round(CASE WHEN dimension = 'security' THEN greatest(mx - deducted, 0)
  ELSE mx - deducted END, 2) AS score, mx AS max
FROM (SELECT *, {_LEGACY} AS mx FROM points) WHERE mx IS NOT NULL""")
def score_breakdown(spark, d):
    return score.breakdown(_scored(spark, d).points)


def _quality(has_threats: str) -> str:
    grade = "CASE " + " ".join(f"WHEN score >= {b} THEN '{g}'" for g, b in vocab.GRADES) + \
        " ELSE 'F' END"
    return f"""SELECT score, {grade} AS grade, round(least(100, log10(rows + 1) * 20), 1)
    AS confidence, round(missing_pct, 2) AS missing_pct, round(dups * 100.0 / rows, 2) AS dup_pct,
    total AS total_deduction, failing AS failing_dimensions, rows FROM (
  SELECT *, round(CASE WHEN total < 5 THEN least(s2, 95) WHEN total < 15 THEN least(s2, 88)
    ELSE s2 END, 2) AS score FROM (SELECT *, CASE WHEN failing >= 5 OR total >= 75 OR (
      missing_pct > 30 AND garbage > 5 AND dups > 10) THEN least(s1, 38) ELSE s1 END AS s2 FROM (
    SELECT *, CASE WHEN {has_threats} THEN least(greatest(100 - total, 0), 30)
      ELSE greatest(100 - total, 0) END AS s1 FROM (
      SELECT round((SELECT sum(deducted) FROM points) + (SELECT deduction FROM comp), 2) AS total,
        (SELECT failing FROM comp) AS failing, (SELECT {_MISS} FROM gaps) AS missing_pct,
        {_GARBAGE} AS garbage, {_DUP} AS dups, (SELECT count(*) FROM people) AS rows))))"""


_Q = ("score", "grade", "confidence", "missing_pct", "dup_pct", "total_deduction",
      "failing_dimensions", "rows")


@query("quality", f"{s.people(*CTES)} {_quality('(SELECT count(*) FROM threats) > 0')}")
def quality(spark, d):
    return _scored(spark, d).quality.select(*_Q)


@query("quality_plain", f"{s.people(*PLAIN_CTES)} {_quality('false')}")
def quality_plain(spark, d):
    """Without security and PII, as the cleaning pipeline scores."""
    return _scored(spark, d, PLAIN).quality.select(*_Q)


@query("quality_all_methods")
def quality_all_methods(spark, d):
    """With the isolation forest and a mixed-delimiter finding of a raw file."""
    info = pin(delimiters.delimiter_report(q_ingest._lines(spark, d)))
    cfg = score.ScoreConfig(method="all", as_of=AS_OF)
    return score.score(people(spark, d), cfg, info).quality


@query("quality_lineitem")
def quality_lineitem(spark, d):
    """The whole score on the largest table."""
    return _scored_table(table(spark, d, "lineitem", wide=True))


@query("quality_documents")
def quality_documents(spark, d):
    return _scored_table(table(spark, d, "documents", wide=True))


def _scored_table(df):
    return score.score(df, CONFIG).quality


_FACTS = f"""q AS ({_quality('(SELECT count(*) FROM threats) > 0')}),
an AS (SELECT CAST(sum(distinct_values) AS BIGINT) AS n, count(*) AS c, max(distinct_values) AS m,
  arg_max("column", (distinct_values, "column")) AS w, list("column" ORDER BY "column")
  FILTER (WHERE distinct_values >= 5) AS busy FROM anomalies),
va AS (SELECT count(*) AS n, list(columns ORDER BY columns) AS cols FROM pen
  WHERE dimension = 'validity'),
fo AS (SELECT count(*) AS n FROM pen WHERE dimension = 'consistency' AND columns = 'signup_date'),
th AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM threats),
pi AS (SELECT count(*) AS n, list("column" ORDER BY "column") FILTER (WHERE confidence = 'high')
  AS high FROM pii_columns),
ds AS (SELECT dimension, greatest(round(100 - least(deducted / {_DIV} * 100, 100), 1), 0) AS score
  FROM points)"""


def _lines(items: list[tuple[str, str]], limit: int) -> str:
    """The texts whose condition holds, the first ones, numbered."""
    cases = ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in items)
    return f"""SELECT CAST(generate_subscripts(l, 1) AS BIGINT) AS position, unnest(l) AS text
  FROM (SELECT list_filter([{cases}], lambda x: x IS NOT NULL)[1:{limit}] AS l
        FROM q, an, va, fo, th, pi)"""


_KEY_ISSUES = _lines([
    ("missing_pct > 20", "printf('%.1f%% of values are missing, a significant gap', missing_pct)"),
    ("missing_pct > 5 AND missing_pct <= 20",
     "printf('%.1f%% of values are missing, consider imputation', missing_pct)"),
    ("dup_pct > 0", "printf('%.1f%% of rows are duplicates', dup_pct)"),
    ("an.n > 0", "printf('%d anomalous values in %d column(s), worst ''%s'' (%d)', an.n, an.c, w, m)"),
    ("va.n > 0", "printf('%d validity issue(s) in %s', va.n, array_to_string(cols, ', '))"),
    ("fo.n > 0", "'Mixed date formats in signup_date'"),
    ("th.n > 0", "printf('%d security threat(s)', th.n)"),
    ("pi.n > 0", "printf('PII in %d column(s)', pi.n)"),
    ("score < 40", "printf('Score is critically low (%.0f)', score)")], 5)
_RECOMMENDATIONS = _lines([
    ("missing_pct > 5", "'Fill missing values by median or mode'"),
    ("len(busy) > 0", "'Review outliers in ' || array_to_string(busy[1:3], ', ')"),
    ("th.n > 0", "'Strip or escape injection payloads'"),
    ("len(high) > 0", "'Mask personal data in ' || array_to_string(high[1:3], ', ')"),
    ("(SELECT score FROM ds WHERE dimension = 'completeness') < 70",
     "'Run the cleaning pipeline to complete the data'"),
    ("(SELECT score FROM ds WHERE dimension = 'uniqueness') < 70", "'Remove duplicate rows'"),
    ("score < 60", "'Apply all suggested repairs with the cleaning pipeline'")], 6)


@query("report_key_issues", f"{s.people(*CTES, _FACTS)} {_KEY_ISSUES}")
def report_key_issues(spark, d):
    return report.key_issues(report.facts(_scored(spark, d)))


@query("report_recommendations", f"{s.people(*CTES, _FACTS)} {_RECOMMENDATIONS}")
def report_recommendations(spark, d):
    return report.recommendations(report.facts(_scored(spark, d)))


@query("report_summary", f"""{s.people(*CTES)} SELECT score, grade, CASE WHEN score >= 90
  THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' WHEN score >= 40
  THEN 'Poor' ELSE 'Critical' END AS label, score >= 60 AS usable, concat_ws(',',
  CASE WHEN (SELECT count(*) FROM threats) > 0 THEN 'security payloads' END,
  CASE WHEN (SELECT count_if(confidence = 'high') FROM pii_columns) > 0 THEN 'personal data' END)
  AS risks FROM ({_quality('(SELECT count(*) FROM threats) > 0')})""")
def report_summary(spark, d):
    return report.summary(report.facts(_scored(spark, d))).select(
        "score", "grade", "label", "usable", F.array_join("risks", ",").alias("risks"))


@query("report_anomalies", f"""{s.people(*_COMMON, *_ANOM)}
SELECT "column", distinct_values AS affected, CASE WHEN distinct_values >= 20 THEN 'high'
  WHEN distinct_values >= 5 THEN 'medium' ELSE 'low' END AS severity FROM anomalies""")
def report_anomalies(spark, d):
    return report.anomaly_rows(anomalies.detect(people(spark, d), "iqr")).drop("methods")


@query("report_pii", f"""{s.people(*_COMMON, qs.PII_COUNTS, qs.PII_COLUMNS)}
SELECT "column", pii_type, confidence AS risk_level FROM pii_columns""")
def report_pii(spark, d):
    return report.pii_rows(pii.columns(pii.match_counts(people(spark, d))))


@query("report_security", f"""{s.people(*_COMMON, qs._counts_cte('text_cells'))}
SELECT "column", threat_type, n AS rows FROM threats""")
def report_security(spark, d):
    return report.security_lines(security.threat_counts(people(spark, d)))


@query("report_drift", f"""{q_compare.DRIFT_WITH} SELECT "column", p < 0.05 AS drift_detected,
  round(p, 4) AS p_value, CASE WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'medium' ELSE 'low' END
  AS severity FROM drifts""")
def report_drift(spark, d):
    rows = report.drift_rows(drift.detect(people(spark, d), people_v2(spark, d)))
    return rows.withColumn("p_value", F.round("p_value", 4))


@query("null_row_penalty", f"""{s.people()} SELECT 'completeness' AS dimension,
  CASE WHEN n > 5 THEN 'high' ELSE 'medium' END AS impact,
  CAST(least(n * 2, 10) AS DOUBLE) AS deduction
  FROM (SELECT count(*) AS n FROM people WHERE id % 97 = 3) WHERE n > 0""")
def null_row_penalty(spark, d):
    """Rows without any value among the others."""
    df = people(spark, d)
    empty = df.where("id % 97 = 3").select(*[
        F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    found = score.score(df.unionByName(empty), PLAIN).penalties
    return found.where(F.col("reason").contains("empty row")).select(
        "dimension", "impact", "deduction")


@query("analyze", f"""{s.people(*CTES)} SELECT score, grade, rows,
  (SELECT count(*) FROM anomalies) AS anomalous_columns,
  CASE WHEN (SELECT count_if(confidence = 'high') FROM pii_columns) >= 1 THEN 'high'
    WHEN (SELECT count_if(confidence = 'medium') FROM pii_columns) >= 2 THEN 'medium'
    WHEN (SELECT count(*) FROM pii_columns) > 0 THEN 'low' ELSE 'none' END AS pii_risk,
  (SELECT CAST(sum(n) AS BIGINT) FROM threats) AS threats
FROM ({_quality('(SELECT count(*) FROM threats) > 0')})""")
def analyze(spark, d):
    return report.analyze(people(spark, d), CONFIG)


@query("anomaly_alert", f"""{s.people(*_COMMON, *_ANOM)} SELECT 'anomaly_detected' AS alert_type,
  CASE WHEN t > 100 THEN 'critical' WHEN t > 20 THEN 'high' ELSE 'medium' END AS severity,
  t AS total FROM (SELECT CAST(sum(distinct_values) AS BIGINT) AS t FROM anomalies)""")
def anomaly_alert(spark, d):
    found = anomalies.detect(people(spark, d), "iqr")
    return alerts.anomaly_alerts(found, "people", 1).select(
        "alert_type", "severity", F.col("details")["total"].cast("bigint").alias("total"))


@query("drift_alert", f"""{q_compare.DRIFT_WITH} SELECT 'drift_detected' AS alert_type, 'high' AS
  severity, string_agg("column", ',' ORDER BY "column") AS columns FROM drifts WHERE p < 0.05
  HAVING count(*) > 0""")
def drift_alert(spark, d):
    found = drift.detect(people(spark, d), people_v2(spark, d))
    return alerts.drift_alerts(found, "people", 2).select(
        "alert_type", "severity", F.col("details")["columns"].alias("columns"))


@query("score_history")
def score_history(spark, d):
    """Score of both versions through the same configuration."""
    return forecast.history({("people", 1): people(spark, d),
                             ("people", 2): people_v2(spark, d)}, CONFIG)
