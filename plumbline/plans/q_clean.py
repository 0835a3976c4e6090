"""Repair suggestions and cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import cleaning, repair
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table, view
from plumbline.plans.q_scalar import _canonical
from plumbline.plans.q_score import CONFIG
from plumbline.plans.registry import query

_NUMBER_OF = {"age": "CAST(age AS DOUBLE)", "salary": "salary",
              "score_text": s.as_num("score_text")}


def _text_counts():
    parts = []
    for c in s.STRINGS:
        junk = f"{s.folded(c)} IN {s.values(vocab.JUNK_REPAIR)}"
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS known,
          count_if({junk}) AS junk, count_if({c} IS NULL OR {junk}) AS missing,
          count_if({s.is_num(c)}) AS numeric,
          count_if(NOT {s.is_num(c)} AND NOT ({junk})) AS invalid_text FROM people""")
    return f"tc AS ({' UNION ALL '.join(parts)})"


_ISO = s.match(s.strip("signup_date"), vocab.ISO_DATE)
_DATED = f"({s.ambiguous('signup_date')} OR {s.as_date('signup_date')} IS NOT NULL)"
_BAD_EMAIL = f"NOT {s.match(s.strip('email'), vocab.EMAIL_LENIENT)}"
_SYN = f"""SELECT 'country' AS "column", count(DISTINCT country) AS n FROM people
  WHERE country <> {_canonical('country', vocab.COUNTRY_MAP_REPAIR)}"""


def _range(name, lo, hi):
    v = _NUMBER_OF[name]
    return f"count_if({v} < {lo}" + (f" OR {v} > {hi})" if hi is not None else ")")



@query("suggestions", f"""{s.people(_text_counts())}
SELECT * FROM (
  SELECT '__all__' AS "column", 'remove_duplicates' AS action, (SELECT count(*) FROM people)
    - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (id) FROM people)) AS affected
  UNION ALL SELECT "column", 'fix_junk', junk FROM tc
  UNION ALL SELECT "column", 'fix_mixed_types', invalid_text FROM tc WHERE numeric >= 0.6 * known
  UNION ALL SELECT 'age', 'fix_range', {_range('age', 0, 120)} FROM people
  UNION ALL SELECT 'salary', 'fix_range', {_range('salary', 0, None)} FROM people
  UNION ALL SELECT 'score_text', 'fix_range', {_range('score_text', 0, 100)} FROM people
  UNION ALL SELECT 'age', CASE WHEN abs(skewness(age)) > 1 THEN 'fill_median' ELSE 'fill_mean'
    END, count_if(age IS NULL) FROM people
  UNION ALL SELECT 'score_text', CASE WHEN abs(skewness({s.as_num('score_text')})) > 1
    THEN 'fill_median' ELSE 'fill_mean' END, (SELECT missing FROM tc WHERE "column" = 'score_text')
    FROM people
  UNION ALL SELECT "column", 'fill_mode', missing FROM tc WHERE numeric < 0.6 * known
  UNION ALL SELECT 'email', 'flag_emails', count_if({_BAD_EMAIL}) FROM people
  UNION ALL SELECT 'signup_date', 'fix_dates', count_if(NOT {_ISO} AND NOT {_DATED}) FROM people
  UNION ALL SELECT 'signup_date', 'standardize_dates', count_if(NOT {_ISO} AND {_DATED})
    FROM people
  UNION ALL SELECT "column", 'normalize_categories', n FROM ({_SYN})
  UNION ALL SELECT "column", 'review_column', missing FROM tc WHERE missing * 100.0 / rows >= 50)
WHERE affected > 0""")
def suggestions(spark, d):
    return repair.suggest(people(spark, d)).select("column", "action", "affected")


@query("suggestion_fills", f"""{s.people()}
SELECT 'age' AS "column", CASE WHEN abs(skewness(age)) > 1 THEN median(age) ELSE avg(age) END
  AS fill_value FROM people
UNION ALL SELECT 'score_text', CASE WHEN abs(skewness(v)) > 1 THEN median(v)
  ELSE round(avg(v), 2) END FROM (SELECT {s.as_num('score_text')} AS v FROM people)""")
def suggestion_fills(spark, d):
    return repair.suggest(people(spark, d)).where(
        F.col("action").isin("fill_mean", "fill_median")).select(
            "column", F.col("fill_value").cast("double").alias("fill_value"))


_STEP1 = ", ".join(f"{s.null_words(c)} AS {c}" if c in s.STRINGS else c for c in s.COLUMNS)
_ST1 = f"st1 AS (SELECT {_STEP1} FROM people)"
_ST2 = f"st2 AS (SELECT * REPLACE ({s.as_num('score_text')} AS score_text) FROM st1)"
_ST3 = """st3 AS (SELECT * REPLACE (CASE WHEN age BETWEEN 0 AND 120 THEN age END AS age,
  CASE WHEN salary >= 0 THEN salary END AS salary,
  CASE WHEN score_text BETWEEN 0 AND 100 THEN score_text END AS score_text) FROM st2)"""


def _fill(c):
    return (f"coalesce(CAST({c} AS DOUBLE), (SELECT CASE WHEN abs(skewness({c})) > 1 "
            f"THEN quantile_cont({c}, 0.5) ELSE avg({c}) END FROM st3)) AS {c}")


_ST4 = f"st4 AS (SELECT * REPLACE ({_fill('age')}, {_fill('salary')}, {_fill('score_text')}) FROM st3)"


def _mode(c):
    return (f"coalesce({c}, (SELECT {c} FROM st4 WHERE {c} IS NOT NULL GROUP BY 1 "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}")


_ST5 = ("st5 AS (SELECT * REPLACE (" + ", ".join(
    _mode(c) for c in ("name", "email", "phone")) + ") FROM st4)")
_ST6 = "st6 AS (SELECT DISTINCT * FROM st5)"
_ST7 = f"""st7 AS (SELECT * REPLACE (CASE WHEN year({s.as_date('signup_date')}) NOT BETWEEN 1900
  AND 2100 THEN NULL ELSE signup_date END AS signup_date) FROM st6)"""
_ST8 = f"""st8 AS (SELECT * REPLACE (CASE WHEN {s.match(s.strip('email'), vocab.EMAIL_LENIENT)}
  THEN email END AS email) FROM st7)"""
_ST9 = f"""st9 AS (SELECT * REPLACE ({_canonical('country', vocab.COUNTRY_MAP_CLEANING)}
  AS country) FROM st8)"""
_ST10 = ("st10 AS (SELECT * REPLACE (" + ", ".join(
    f"{s.strip(c)} AS {c}" for c in s.STRINGS if c != "score_text") + ") FROM st9)")
STEPS = (_ST1, _ST2, _ST3, _ST4, _ST5, _ST6, _ST7, _ST8, _ST9, _ST10)


def _money(df, *names):
    return df.select([F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _upto(k, *rounded):
    cols = ", ".join(f"round({c}, 6) AS {c}" if c in rounded else c for c in s.COLUMNS)
    return f"{s.people(*STEPS[:k])} SELECT {cols} FROM st{k}"


@query("clean_junk", _upto(1))
def clean_junk(spark, d):
    return cleaning.junk_normalise(people(spark, d))[0]


def _run(df, *steps):
    for step in steps:
        df = step(df)[0]
    return df


_FIRST = (cleaning.junk_normalise, cleaning.fix_mixed_types, cleaning.fix_domain_values)


@query("clean_mixed_types", _upto(2))
def clean_mixed_types(spark, d):
    return _run(people(spark, d), *_FIRST[:2])


@query("clean_domain", _upto(3))
def clean_domain(spark, d):
    return _run(people(spark, d), *_FIRST)


_FILLED = ("age", "salary", "score_text")


@query("clean_fill_numeric", _upto(4, *_FILLED))
def clean_fill_numeric(spark, d):
    return _money(_run(people(spark, d), *_FIRST, cleaning.fill_numeric), *_FILLED)


@query("clean_fill_categorical", _upto(5, *_FILLED))
def clean_fill_categorical(spark, d):
    return _money(_run(people(spark, d), *_FIRST, cleaning.fill_numeric,
                       cleaning.fill_categorical), *_FILLED)


@query("clean_duplicates", f"{s.people()} SELECT DISTINCT * FROM people")
def clean_duplicates(spark, d):
    return cleaning.remove_duplicates(people(spark, d))[0]


_US_DATE = """CASE o_orderkey % 9 WHEN 0 THEN 'soon' WHEN 4 THEN '03/04/1850' ELSE
  concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
  lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/',
  CAST(year(o_orderdate) AS STRING)) END"""


@query("clean_dates", f"""WITH t AS (SELECT o_orderkey, {_US_DATE} AS order_date FROM orders)
SELECT o_orderkey, CASE WHEN order_date = 'soon' THEN order_date
  WHEN year(strptime(order_date, '%d/%m/%Y')) NOT BETWEEN 1900 AND 2100 THEN NULL
  ELSE strftime(strptime(order_date, '%d/%m/%Y'), '%Y-%m-%d') END AS order_date
FROM (SELECT o_orderkey, nullif(order_date, 'soon') AS x, order_date FROM t
      WHERE order_date <> 'soon')
UNION ALL SELECT o_orderkey, order_date FROM t WHERE order_date = 'soon'""")
def clean_dates(spark, d):
    t = table(spark, d, "orders").selectExpr("o_orderkey", f"{_US_DATE} AS order_date")
    return cleaning.standardise_dates(t)[0]


@query("clean_emails", f"""{s.people()} SELECT id, CASE WHEN {_BAD_EMAIL} THEN NULL ELSE email
END AS email FROM people""")
def clean_emails(spark, d):
    return cleaning.fix_emails(people(spark, d).select("id", "email"))[0]


@query("clean_countries", f"""{s.people()}
SELECT id, {_canonical('country', vocab.COUNTRY_MAP_CLEANING)} AS country FROM people""")
def clean_countries(spark, d):
    return cleaning.normalise_countries(people(spark, d).select("id", "country"))[0]


@query("clean_text", f"""{s.people()} SELECT id, upper({s.strip('name')}) AS name,
upper({s.strip('status')}) AS status FROM people""")
def clean_text(spark, d):
    return cleaning.normalise_text(people(spark, d).select("id", "name", "status"), "upper")[0]


def _fence(source, c):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return (f"(SELECT {q1} - 1.5 * ({q3} - {q1}) AS lo, {q3} + 1.5 * ({q3} - {q1}) AS hi "
            f"FROM {source})")


_EV = "WITH t0 AS (SELECT event_id, value, length(event_type) * value AS weight FROM events)"


@query("clean_outliers", f"""{_EV},
t1 AS (SELECT t0.* FROM t0, {_fence('t0', 'event_id')} f WHERE event_id BETWEEN lo AND hi),
t2 AS (SELECT t1.* FROM t1, {_fence('t1', 'value')} f WHERE value BETWEEN lo AND hi),
t3 AS (SELECT t2.* FROM t2, {_fence('t2', 'weight')} f WHERE weight BETWEEN lo AND hi)
SELECT * FROM t3""")
def clean_outliers(spark, d):
    """Fences one column after the other, each on the rows the previous one left."""
    t = table(spark, d, "events").selectExpr(
        "event_id", "value", "length(event_type) * value AS weight")
    return cleaning.remove_outliers(t)[0]


@query("clean_outliers_joint", f"""{_EV}
SELECT t0.* FROM t0, {_fence('t0', 'event_id')} e, {_fence('t0', 'value')} v,
  {_fence('t0', 'weight')} w WHERE event_id BETWEEN e.lo AND e.hi
  AND value BETWEEN v.lo AND v.hi AND weight BETWEEN w.lo AND w.hi""")
def clean_outliers_joint(spark, d):
    t = table(spark, d, "events").selectExpr(
        "event_id", "value", "length(event_type) * value AS weight")
    return cleaning.remove_outliers(t, "joint")[0]


@query("clean_table", _upto(10, *_FILLED))
def clean_table(spark, d):
    """All default steps in order."""
    return _money(cleaning.transform(people(spark, d))[0], *_FILLED)



def _lost(k, cols):
    """Cells that are null after step k but were not before."""
    return (f"SELECT (SELECT {' + '.join(f'count({c})' for c in cols)} FROM st{k - 1}) - "
            f"(SELECT {' + '.join(f'count({c})' for c in cols)} FROM st{k}) AS n")


_COUNTRY_N = f"""SELECT count_if(country <> {_canonical('country', vocab.COUNTRY_MAP_CLEANING)})
  AS n FROM st8"""
_TEXT_N = " + ".join(f"count_if({c} <> {s.strip(c)})" for c in s.STRINGS if c != "score_text")


@query("repair_steps", f"""{s.people(*STEPS)}
SELECT * FROM (
SELECT 'junk_normalise' AS key, (SELECT {' + '.join(f'count({c})' for c in s.STRINGS)}
  FROM people) - (SELECT {' + '.join(f'count({c})' for c in s.STRINGS)} FROM st1) AS rows_affected
UNION ALL SELECT 'mixed_type_fix', n FROM ({_lost(2, ['score_text'])})
UNION ALL SELECT 'domain_fix', n FROM ({_lost(3, _FILLED)})
UNION ALL SELECT 'fill_numeric', -n FROM ({_lost(4, _FILLED)})
UNION ALL SELECT 'fill_categorical', -n FROM ({_lost(5, ('name', 'email', 'phone'))})
UNION ALL SELECT 'remove_duplicates', (SELECT count(*) FROM st5) - (SELECT count(*) FROM st6)
UNION ALL SELECT 'date_standardise', n FROM ({_lost(7, ['signup_date'])})
UNION ALL SELECT 'email_fix', n FROM ({_lost(8, ['email'])})
UNION ALL SELECT 'country_normalise', n FROM ({_COUNTRY_N})
UNION ALL SELECT 'text_normalise', {_TEXT_N} FROM st9) WHERE rows_affected > 0""")
def repair_steps(spark, d):
    """The ledger of a cleaning run: cells or rows each step changed."""
    _, steps, _ = cleaning.transform(people(spark, d))
    return spark.createDataFrame([(x.key, x.rows_affected) for x in steps],
                                 "key string, rows_affected bigint")


@query("step_confidence", """SELECT key, affected, CASE
  WHEN key IN ('remove_duplicates', 'junk_normalise') THEN 'high'
  WHEN key = 'fill_numeric' AND affected < 10 THEN 'high'
  WHEN key = 'fill_numeric' AND affected < 30 THEN 'medium'
  WHEN key = 'remove_outliers' AND affected > 5 THEN 'low' ELSE 'medium' END AS confidence
FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'remove_duplicates' WHEN 1 THEN 'fill_numeric'
  WHEN 2 THEN 'remove_outliers' ELSE 'email_fix' END AS key, CAST(p_size AS BIGINT) AS affected
  FROM part)""")
def step_confidence(spark, d):
    t = table(spark, d, "part").selectExpr(
        "CASE p_partkey % 4 WHEN 0 THEN 'remove_duplicates' WHEN 1 THEN 'fill_numeric' "
        "WHEN 2 THEN 'remove_outliers' ELSE 'email_fix' END AS key",
        "CAST(p_size AS BIGINT) AS affected")
    return t.withColumn("confidence", cleaning.confidence(
        F.col("key"), F.col("affected"), F.lit(100)))


_SPARSE = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN o_orderpriority END AS note,
  CASE WHEN o_orderkey % 5 < 2 THEN o_orderdate END AS day,
  CASE WHEN o_orderkey % 10 < 9 THEN o_orderkey % 3 = 0 END AS flag FROM orders"""


@query("suggestions_sparse", f"""WITH t AS ({_SPARSE}), g AS (
  SELECT 'note' AS "column", count(*) AS r, count(*) - count(note) AS m FROM t
  UNION ALL SELECT 'day', count(*), count(*) - count(day) FROM t
  UNION ALL SELECT 'flag', count(*), count(*) - count(flag) FROM t)
SELECT "column", 'missing_values' AS issue_type, 'fill_mode' AS action, m AS affected FROM g
WHERE m > 0
UNION ALL SELECT "column", 'high_missing_rate', 'review_column', m FROM g
WHERE round(m * 100.0 / r, 1) >= 50""")
def suggestions_sparse(spark, d):
    """Text, date and boolean columns with many missing cells."""
    return repair.suggest(view(spark, d, _SPARSE, "orders")).select(
        "column", "issue_type", "action", "affected")


@query("remaining_issues", f"""{s.people()}
SELECT * FROM (SELECT 'missing_values' AS issue, "column", count(*) - count(v) AS count FROM (
    SELECT 'name' AS "column", {s.null_words('name')} AS v FROM people
    UNION ALL SELECT 'age', CAST(age AS VARCHAR) FROM people
    UNION ALL SELECT 'notes', notes FROM people) GROUP BY 2
  UNION ALL SELECT 'duplicates', '__all__', count(*) - (SELECT count(*) FROM (SELECT DISTINCT
    name, age, notes FROM people)) FROM people) WHERE count > 0""")
def remaining_issues(spark, d):
    return cleaning.remaining_issues(people(spark, d).select("name", "age", "notes"))


@query("cleaning_report")
def cleaning_report(spark, d):
    """Scores before and after, rows, grades."""
    return cleaning.clean(people(spark, d), config=CONFIG).report
