"""Root-cause queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import facts, pii, profile, root_cause, score
from plumbline.plans import q_anomaly as qa
from plumbline.plans import q_scan as qs
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table, view
from plumbline.plans.q_score import AS_OF, CONFIG
from plumbline.plans.registry import query

# Penalties of many datasets at once, one per event: the shape a store of score reports has.
_PENALTIES = """SELECT user_id AS dataset_id,
  CASE event_type WHEN 'error' THEN 'validity' WHEN 'purchase' THEN 'consistency'
    WHEN 'view' THEN 'security' WHEN 'click' THEN 'garbage' ELSE 'completeness' END AS dimension,
  CASE event_id % 4 WHEN 0 THEN 'Invalid date found' WHEN 1 THEN 'Mixed date formats'
    WHEN 2 THEN 'PII or email issue' ELSE 'Other finding' END AS reason,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact,
  -floor(value) AS deduction,
  CASE event_id % 5 WHEN 0 THEN 'b,a' WHEN 1 THEN 'a,b' WHEN 2 THEN '' ELSE 'c' END AS cols
FROM events"""


def _penalties(spark, d):
    return view(spark, d, _PENALTIES, "events").withColumn(
        "affected_columns", F.when(F.col("cols") == "", F.array().cast("array<string>"))
        .otherwise(F.split("cols", ","))).withColumn(
            "deduction", F.col("deduction").cast("double"))


_GROUP = "CASE " + " ".join(
    f"WHEN dimension = '{d}'" + (f" AND contains(lower(reason), '{w}')" if w else "")
    + f" THEN '{g}'" for d, w, g in vocab.PENALTY_GROUP_RULES) + \
    f" ELSE '{vocab.DEFAULT_GROUP}' END"
_CAP = "CASE issue_group " + " ".join(
    f"WHEN '{g}' THEN {c}" for g, c in vocab.GROUP_CAPS.items()) + " END"
_DEDUP = f"""p AS ({_PENALTIES}), g AS (SELECT *, {_GROUP} AS issue_group,
  CASE cols WHEN 'b,a' THEN 'a,b' ELSE cols END AS columns FROM p),
dd AS (SELECT dataset_id, issue_group, columns,
  string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reason,
  max(CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS rank,
  CAST(sum(abs(deduction)) AS DOUBLE) AS raw_deduction, count(*) AS merged
  FROM g GROUP BY 1, 2, 3),
dedup AS (SELECT dataset_id, issue_group, columns, reason, CASE rank WHEN 3 THEN 'high' WHEN 2
  THEN 'medium' ELSE 'low' END AS impact, CAST(least(raw_deduction, {_CAP}) AS DOUBLE)
  AS deduction, raw_deduction, CAST(raw_deduction - least(raw_deduction, {_CAP}) AS DOUBLE)
  AS saved, merged FROM dd)"""


@query("penalty_groups", f"""WITH {_DEDUP} SELECT dimension, reason, issue_group, count(*) AS n
FROM g GROUP BY 1, 2, 3""")
def penalty_groups(spark, d):
    p = _penalties(spark, d)
    return p.groupBy("dimension", "reason", root_cause.issue_group(
        F.col("dimension"), F.col("reason")).alias("issue_group")).agg(F.count("*").alias("n"))


@query("dedup_penalties", f"WITH {_DEDUP} SELECT * FROM dedup")
def dedup_penalties(spark, d):
    return root_cause.deduplicate(_penalties(spark, d), ("dataset_id",)).withColumn(
        "columns", F.array_join("affected_columns", ",")).drop("affected_columns")


@query("fair_score", f"""WITH {_DEDUP}, f AS (SELECT dataset_id,
  CAST(greatest(100 - sum(deduction), 0) AS DOUBLE) AS fair_score FROM dedup GROUP BY 1)
SELECT *, CASE WHEN fair_score >= 90 THEN 'A' WHEN fair_score >= 75 THEN 'B'
  WHEN fair_score >= 60 THEN 'C' WHEN fair_score >= 40 THEN 'D' ELSE 'F' END AS fair_grade FROM f""")
def fair_score(spark, d):
    return root_cause.fair_score(root_cause.deduplicate(
        _penalties(spark, d), ("dataset_id",)), ("dataset_id",))


@query("group_impacts", f"""WITH {_DEDUP}, places AS (SELECT issue_group, string_agg(DISTINCT c, ','
  ORDER BY c) AS columns FROM (SELECT issue_group, unnest(string_split(columns, ',')) AS c
  FROM dedup WHERE columns <> '') GROUP BY 1)
SELECT issue_group, CASE max(CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)
  WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS impact,
  CAST(sum(merged) AS BIGINT) AS penalties, round(sum(deduction), 2) AS points,
  round(sum(saved), 2) AS saved, coalesce(any_value(places.columns), '') AS columns
FROM dedup LEFT JOIN places USING (issue_group) GROUP BY 1""")
def group_impacts(spark, d):
    """What each group of penalties does over all score reports."""
    dedup = root_cause.deduplicate(_penalties(spark, d), ("dataset_id",))
    return root_cause.group_impacts(dedup).withColumn("columns", F.array_join("columns", ","))


_D = s.as_date("signup_date")
_LABEL = s.label("signup_date", vocab.DATE_LABELS_CAUSE)
_BAD = f"NOT {s.ambiguous('signup_date')} AND {_D} IS NULL"
DATE_CAUSES = f"""SELECT 'signup_date' AS "column", 'DATE_QUALITY' AS issue_group,
  'mixed_date_formats' AS detection, CASE WHEN k > 2 THEN 'high' ELSE 'medium' END AS severity,
  round(least(0.95, 0.5 + k * 0.1), 4) AS confidence FROM (SELECT CAST(count(DISTINCT {_LABEL})
  AS DOUBLE) AS k FROM people) WHERE k >= 2
UNION ALL SELECT 'signup_date', 'DATE_QUALITY', 'unparseable_dates', 'high', 0.99 FROM (
  SELECT count_if({_BAD}) AS n FROM people) WHERE n > 0"""
_MAIL = f"NOT {s.match(s.strip('email'), vocab.EMAIL_STRICT)}"
EMAIL_CAUSES = f"""SELECT 'email' AS "column", 'EMAIL_QUALITY' AS issue_group, 'invalid_email'
  AS detection, CASE WHEN p >= 0.5 THEN 'high' ELSE 'medium' END AS severity,
  round(least(0.99, 0.6 + p * 0.4), 4) AS confidence FROM (SELECT count_if({_MAIL}) /
  CAST(count(email) AS DOUBLE) AS p FROM people) WHERE p > 0"""
COUNTRY_HITS = " UNION ALL ".join(
    f"""SELECT '{c}' AS canonical, {s.folded('country')} AS v FROM people
      WHERE {s.folded('country')} IN {s.values(sp)}""" for c, sp in vocab.COUNTRY_GROUPS.items())
COUNTRY_CAUSES = f"""SELECT 'country', 'FORMAT_CONSISTENCY', 'category_synonyms', 'low', 0.9
  FROM (SELECT canonical FROM ({COUNTRY_HITS}) GROUP BY 1 HAVING count(DISTINCT v) > 1
        LIMIT 1)"""
_SENT = f"count_if({s.folded('v')} IN {s.values(vocab.GARBAGE_SENTINEL)})"
GARBAGE_CAUSES = f"""SELECT "column", 'GARBAGE_VALUES', 'garbage_values', CASE WHEN p > 0.1
  THEN 'medium' ELSE 'low' END, round(least(0.99, 0.7 + p * 0.3), 4) FROM (SELECT "column",
  {_SENT} / CAST(count(v) AS DOUBLE) AS p FROM text_cells GROUP BY 1) WHERE p > 0"""
ANOMALY_CAUSES = f"""SELECT "column", 'ANOMALY', 'statistical_anomaly', {qa.SEVERITY},
  CASE WHEN k = 3 THEN 0.85 ELSE 0.7 END FROM anomalies"""
PII_CAUSES = """SELECT "column", 'PII_RISK', concat('pii_', pii_type), CASE confidence
  WHEN 'high' THEN 'high' ELSE 'medium' END, CASE confidence WHEN 'high' THEN 0.92
  WHEN 'medium' THEN 0.65 ELSE 0.35 END FROM pii_columns"""
_ANOM = tuple(c.replace("FROM cells", "FROM text_cells") for c in qa.ANOMALY_CTES
              if not c.startswith("cells AS")) + (qa.ANOMALIES,)
_BASE = (s.cells(), s.cells(s.STRINGS, name="text_cells")) + _ANOM + (
    qs.PII_COUNTS, qs.PII_COLUMNS)
CAUSES = f"""causes AS (SELECT "column", issue_group, detection, severity,
  CAST(confidence AS DOUBLE) AS confidence FROM ({DATE_CAUSES} UNION ALL {EMAIL_CAUSES}
  UNION ALL {COUNTRY_CAUSES} UNION ALL {GARBAGE_CAUSES} UNION ALL {ANOMALY_CAUSES}
  UNION ALL {PII_CAUSES}))"""


def _causes(spark, d):
    return root_cause.causes(score.measure(people(spark, d), CONFIG))


@query("root_causes", f"{s.people(*_BASE, CAUSES)} SELECT * FROM causes")
def root_causes(spark, d):
    return _causes(spark, d).drop("explanation")


@query("date_causes", f"{s.people()} {DATE_CAUSES}".replace("0.99 FROM", "0.99::DOUBLE FROM"))
def date_causes(spark, d):
    return root_cause.date_causes(facts.text_facts(people(spark, d), AS_OF)).drop("explanation")


@query("email_causes", f"{s.people()} {EMAIL_CAUSES}")
def email_causes(spark, d):
    return root_cause.email_causes(facts.text_facts(people(spark, d), AS_OF)).drop("explanation")


@query("casing_causes", """WITH t AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN
  lower(o_orderpriority) WHEN 1 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END AS v
  FROM orders), u AS (SELECT count(DISTINCT trim(v)) AS raw, count(DISTINCT lower(trim(v))) AS c
  FROM t) SELECT 'full_name' AS "column", 'FORMAT_CONSISTENCY' AS issue_group,
  'inconsistent_casing' AS detection, 'low' AS severity,
  round(least(0.9, 0.55 + (raw - c) / CAST(raw AS DOUBLE)), 4) AS confidence FROM u
  WHERE raw > c""")
def casing_causes(spark, d):
    t = table(spark, d, "orders").selectExpr(
        "CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN "
        "concat(' ', o_orderpriority) ELSE o_orderpriority END AS full_name")
    return root_cause.casing_causes(t).drop("explanation")


@query("country_variants", f"""{s.people()}
SELECT 'country' AS "column", canonical, string_agg(DISTINCT v, ',' ORDER BY v) AS variants
FROM ({COUNTRY_HITS}) GROUP BY 2 HAVING count(DISTINCT v) > 1""")
def country_variants(spark, d):
    return root_cause.country_variants(people(spark, d)).withColumn(
        "variants", F.array_join("variants", ","))


@query("garbage_causes", f"""{s.people(s.cells(s.STRINGS, name='text_cells'))}
SELECT "column", 'GARBAGE_VALUES' AS issue_group, 'garbage_values' AS detection,
  CASE WHEN p > 0.1 THEN 'medium' ELSE 'low' END AS severity,
  round(least(0.99, 0.7 + p * 0.3), 4) AS confidence FROM (SELECT "column",
  {_SENT} / CAST(count(v) AS DOUBLE) AS p FROM text_cells GROUP BY 1) WHERE p > 0""")
def garbage_causes(spark, d):
    return root_cause.garbage_causes(facts.text_facts(people(spark, d), AS_OF)).drop(
        "explanation")


@query("pii_causes", f"""{s.people(s.cells(), qs.PII_COUNTS, qs.PII_COLUMNS)}
SELECT "column", concat('pii_', pii_type) AS detection, CASE confidence WHEN 'high' THEN 'high'
  ELSE 'medium' END AS severity FROM pii_columns""")
def pii_causes(spark, d):
    found = pii.columns(pii.match_counts(people(spark, d)))
    return root_cause.pii_causes(found).select("column", "detection", "severity")


@query("column_status", f"""{s.people(*_BASE, CAUSES)}
SELECT "column", CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)
  WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS status, count(*) AS causes
FROM causes GROUP BY 1""")
def column_status(spark, d):
    return root_cause.column_status(_causes(spark, d))


_STEP_ROWS = """('DATE_QUALITY', 'parse_dates', 'x'), ('DATE_QUALITY',
  'standardize_date_format', 'medium'), ('DATE_QUALITY', 'drop_unparseable_dates', 'low'),
  ('EMAIL_QUALITY', 'validate_drop_invalid_emails', 'x'),
  ('EMAIL_QUALITY', 'normalize_email_casing', 'low'),
  ('GARBAGE_VALUES', 'replace_garbage_with_nan', 'y')"""
_FILLS = " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'fill_mode' AS action, 'low' AS priority FROM people "
     f"HAVING count({s.null_words(c)}) < count(*)" for c in s.STRINGS]
    + [f"SELECT '{c}', CASE WHEN abs(skewness({c})) > 1 THEN 'fill_median' ELSE 'fill_mean' "
       f"END, 'medium' FROM people HAVING count({c}) < count(*)" for c in s.NUMBERS])


@query("fix_steps", f"""{s.people(*_BASE, CAUSES)}, steps(issue_group, action, rule) AS (
VALUES {_STEP_ROWS}), cg AS (SELECT "column", issue_group, max(CASE severity WHEN 'high' THEN 3
  WHEN 'medium' THEN 2 ELSE 1 END) AS k FROM causes GROUP BY 1, 2)
SELECT "column", action, CASE WHEN rule = 'x' THEN CASE k WHEN 3 THEN 'high' ELSE 'medium' END
  WHEN rule = 'y' THEN CASE k WHEN 2 THEN 'medium' ELSE 'low' END ELSE rule END AS priority
FROM cg JOIN steps USING (issue_group)
UNION ALL SELECT "column", 'normalize_country_synonyms', 'low' FROM cg
  WHERE issue_group = 'FORMAT_CONSISTENCY' AND "column" = 'country'
UNION ALL SELECT * FROM ({_FILLS})""")
def fix_steps(spark, d):
    df = people(spark, d)
    m = score.measure(df, CONFIG)
    return root_cause.fix_steps(df, root_cause.causes(m), m.missing).select(
        "column", "action", "priority")


@query("fill_values", f"""{s.people()}
SELECT 'age' AS "column", CASE WHEN abs(skewness(age)) > 1 THEN 'median' ELSE 'mean' END
  AS strategy, count_if(age IS NULL) AS missing_count FROM people""")
def fill_values(spark, d):
    df = people(spark, d).select("age", "quantity")
    return root_cause.fill_values(df, profile.missing(df)).select(
        "column", "strategy", "missing_count")
