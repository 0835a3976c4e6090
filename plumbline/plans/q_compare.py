"""Drift and change queries between the two dirtied versions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import changes, drift
from plumbline.operators.versions import VersionStore
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import PEOPLE_V2, people, people_v2, table
from plumbline.plans.registry import query
from plumbline.plans.session import scratch_path

_NUM = ("id", "age", "salary", "quantity")
_CAT = ("name", "email", "score_text", "phone", "country", "status", "signup_date")


def _versions(spark, d):
    return people(spark, d), people_v2(spark, d)


_SIDES = (s.numbers(_NUM, "people", "na"), s.numbers(_NUM, "people_v2", "nb"))
_KS = """ks AS (SELECT "column", max(t_a) AS n_a, max(t_b) AS n_b,
  max(abs(ca / CAST(t_a AS DOUBLE) - cb / CAST(t_b AS DOUBLE))) AS statistic FROM (
  SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb,
    sum(a) OVER (PARTITION BY "column") AS t_a, sum(b) OVER (PARTITION BY "column") AS t_b
  FROM (SELECT "column", v, sum(a) AS a, sum(b) AS b FROM (
    SELECT "column", v, 1 AS a, 0 AS b FROM na WHERE v IS NOT NULL
    UNION ALL SELECT "column", v, 0, 1 FROM nb WHERE v IS NOT NULL) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY "column" ORDER BY v)) GROUP BY 1)"""


def _ks_p(d="statistic"):
    lam = f"({d} * sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)))"
    tail = " + ".join(f"{2.0 if k % 2 else -2.0} * exp(-2.0 * {k * k} * {lam} * {lam})"
                      for k in range(1, 6))
    head = " + ".join(f"exp(-{(2 * k - 1) ** 2} * {math.pi ** 2!r} / (8.0 * {lam} * {lam}))"
                      for k in range(1, 5))
    return (f"greatest(0.0, least(1.0, CASE WHEN {lam} < 0.2 THEN 1.0 WHEN {lam} < 1.1 THEN "
            f"1.0 - {math.sqrt(2 * math.pi)!r} / {lam} * ({head}) ELSE {tail} END))")


@query("ks_statistic", f"""{s.both_versions(*_SIDES, _KS)}
SELECT "column", CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b,
       round(statistic, 8) AS statistic, round({_ks_p()}, 6) AS p_value FROM ks""")
def ks_statistic(spark, d):
    ks = drift.ks_statistics(*_versions(spark, d), list(_NUM))
    return ks.select("column", "n_a", "n_b", F.round("statistic", 8).alias("statistic"),
                     F.round(stats.ks_pvalue(F.col("statistic"), F.col("n_a"), F.col("n_b")), 6)
                     .alias("p_value"))


def _halves(spark, d):
    """Line items by flag: returned ones against all the others."""
    li = table(spark, d, "lineitem", wide=True).select(
        "l_extendedprice", "l_quantity", "l_discount", "l_linestatus", "l_returnflag")
    return (li.where("l_returnflag = 'R'").drop("l_returnflag"),
            li.where("l_returnflag <> 'R'").drop("l_returnflag"))


_LNUM = ("l_extendedprice", "l_quantity", "l_discount")


@query("ks_statistic_lineitem", f"""WITH r AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'),
o AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R'), {s.numbers(_LNUM, 'r', 'na')},
{s.numbers(_LNUM, 'o', 'nb')}, {_KS}
SELECT "column", CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b,
       round(statistic, 8) AS statistic FROM ks""")
def ks_statistic_lineitem(spark, d):
    return drift.ks_statistics(*_halves(spark, d), list(_LNUM)).withColumn(
        "statistic", F.round("statistic", 8))


_MOMENTS = """SELECT a."column", a.mean AS mean_a, b.mean AS mean_b,
  round(b.m - a.m, 4) AS mean_shift, round(b.s - a.s, 4) AS std_shift
FROM (SELECT "column", round(avg(v), 4) AS mean, avg(v) AS m, stddev_samp(v) AS s
      FROM na GROUP BY 1) a
JOIN (SELECT "column", round(avg(v), 4) AS mean, avg(v) AS m, stddev_samp(v) AS s
      FROM nb GROUP BY 1) b USING ("column")"""


@query("mean_shift", f"{s.both_versions(*_SIDES)} {_MOMENTS}")
def mean_shift(spark, d):
    m = drift.numeric_moments(*_versions(spark, d), list(_NUM))
    return m.select("column", F.round("mean_a", 4).alias("mean_a"),
                    F.round("mean_b", 4).alias("mean_b"),
                    F.round(F.col("mean_b") - F.col("mean_a"), 4).alias("mean_shift"),
                    F.round(F.col("std_b") - F.col("std_a"), 4).alias("std_shift"))


def _paired(a, b):
    return f"""paired AS (SELECT "column", value, sum(a) AS a, sum(b) AS b FROM (
  SELECT "column", {s.null_words('v')} AS value, 1 AS a, 0 AS b FROM {a}
  UNION ALL SELECT "column", {s.null_words('v')}, 0, 1 FROM {b}) WHERE value IS NOT NULL
  GROUP BY 1, 2)"""


_CHI = """chi AS (SELECT "column", CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b,
  count(*) AS categories, sum(power(a + 1e-9 - e, 2) / e) AS statistic FROM (
  SELECT *, (b + 1e-9) * sum(a + 1e-9) OVER w / sum(b + 1e-9) OVER w AS e FROM paired
  WINDOW w AS (PARTITION BY "column")) GROUP BY 1)"""
_PEOPLE_PAIRED = s.both_versions(s.cells(_CAT, "people", "ca"), s.cells(_CAT, "people_v2", "cb"),
                                 _paired("ca", "cb"))


@query("chi2_statistic", f"""{_PEOPLE_PAIRED}, {_CHI}
SELECT "column", n_a, n_b, categories, round(ln(1 + statistic), 5) AS log_statistic FROM chi""")
def chi2_statistic(spark, d):
    return drift.chi2_statistics(*_versions(spark, d), list(_CAT)).select(
        "column", "n_a", "n_b", "categories",
        F.round(F.log(1 + F.col("statistic")), 5).alias("log_statistic"))


@query("chi2_statistic_orders", f"""WITH e AS (SELECT * FROM orders WHERE o_orderdate <
  TIMESTAMP '1998-01-01'), f AS (SELECT * FROM orders WHERE o_orderdate >=
  TIMESTAMP '1998-01-01'), {s.cells(('o_orderstatus', 'o_orderpriority'), 'e', 'ca')},
{s.cells(('o_orderstatus', 'o_orderpriority'), 'f', 'cb')}, {_paired('ca', 'cb')}, {_CHI}
SELECT "column", n_a, n_b, categories, round(statistic, 4) AS statistic FROM chi""")
def chi2_statistic_orders(spark, d):
    """Early orders against late ones."""
    o = table(spark, d, "orders")
    cut = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    keep = ["o_orderstatus", "o_orderpriority"]
    return drift.chi2_statistics(
        o.where(F.col("o_orderdate") < cut).select(keep),
        o.where(F.col("o_orderdate") >= cut).select(keep), keep).withColumn(
            "statistic", F.round("statistic", 4))


def _chi_p(terms: int = 8000) -> str:
    """Upper tail of the chi-square distribution by the power series of the lower one."""
    a, z = "((categories - 1) / 2.0)", "(greatest(statistic, 0) / 2.0)"
    return (f"CASE WHEN categories < 2 OR {z} = 0 THEN 1.0 WHEN {z} > 2 * {a} + 1000 THEN 0.0 "
            f"ELSE greatest(0.0, 1.0 - (SELECT sum(exp(({a} + k) * ln({z}) - {z} "
            f"- lgamma({a} + 1 + k))) FROM range({terms}) t(k))) END")


#: column, drift_type, test, p of every column of the two versions
DRIFT_CTES = (_KS, f"""drifts AS (
  SELECT "column", 'numerical' AS drift_type, 'ks_test' AS test, {_ks_p()} AS p FROM ks
  UNION ALL SELECT "column", 'categorical', 'chi2_test', {_chi_p()} FROM chi)""")
_SEVERITY = "CASE WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'medium' ELSE 'low' END"
DRIFT_WITH = f"{_PEOPLE_PAIRED}, {_CHI}, {', '.join(_SIDES)}, {', '.join(DRIFT_CTES)}"


@query("drift", f"""{DRIFT_WITH} SELECT "column", drift_type, test, round(p, 4) AS p_value,
  p < 0.05 AS is_drifted, {_SEVERITY} AS severity FROM drifts""")
def drift_report(spark, d):
    """Every column of the two versions, tested."""
    return drift.detect(*_versions(spark, d)).select(
        "column", "drift_type", "test", F.round("p_value", 4).alias("p_value"), "is_drifted",
        "severity")


@query("drift_identical", f"""{s.people(s.cells())} SELECT DISTINCT "column", 'identical' AS test,
  false AS is_drifted, 'low' AS severity FROM cells""")
def drift_identical(spark, d):
    """A version compared with itself."""
    a = people(spark, d)
    return drift.between_versions(a, 3, a, 3).select("column", "test", "is_drifted", "severity")


# upper 5 % point of chi-square by the cube-root normal approximation
_CHI_DRIFTED = """categories > 1 AND (power(greatest(statistic, 0) / (categories - 1), 1.0 / 3)
  - (1 - 2 / (9.0 * (categories - 1)))) / sqrt(2 / (9.0 * (categories - 1))) > 1.6448536"""


@query("drift_summary", f"""{_PEOPLE_PAIRED}, {_CHI}, {', '.join(_SIDES)}, {_KS},
d AS (SELECT "column", {_CHI_DRIFTED} AS hit FROM chi UNION ALL
      SELECT "column", {_ks_p()} < 0.05 FROM ks)
SELECT count_if(hit) AS drifted, count_if(NOT hit) AS stable,
  string_agg("column", ',' ORDER BY "column") FILTER (WHERE hit) AS drifted_columns FROM d""")
def drift_summary(spark, d):
    return drift.summary(drift.detect(*_versions(spark, d))).select(
        "drifted", "stable", F.array_join("drifted_columns", ",").alias("drifted_columns"))


@query("drift_self", f"""{s.people(s.cells())} SELECT "column", 0.0::DOUBLE AS statistic,
false AS is_drifted FROM (SELECT DISTINCT "column" FROM cells)""")
def drift_self(spark, d):
    """A table against itself: nothing may drift."""
    a = people(spark, d)
    return drift.detect(a, a).select("column", F.round("statistic", 9).alias("statistic"),
                                     "is_drifted")


def _types(columns, source):
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", any_value(typeof({c})) AS t "
                              f"FROM {source}" for c in columns)
    return (f"SELECT \"column\", CASE t WHEN 'VARCHAR' THEN 'string' ELSE lower(t) END AS t "
            f"FROM ({rows})")


@query("column_changes", f"""{s.both_versions()}
SELECT CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'type' END
  AS change, "column", a.t AS before, b.t AS after
FROM ({_types(s.COLUMNS, 'people')}) a
FULL JOIN ({_types(PEOPLE_V2, 'people_v2')}) b USING ("column")
WHERE a.t IS DISTINCT FROM b.t""")
def column_changes(spark, d):
    return changes.column_changes(*_versions(spark, d))


@query("row_changes", f"""{s.both_versions()} SELECT a AS rows_before, b AS rows_after,
b - a AS change, round((b - a) * 100.0 / a, 2) AS change_pct FROM (SELECT
(SELECT count(*) FROM people) AS a, (SELECT count(*) FROM people_v2) AS b)""")
def row_changes(spark, d):
    return changes.row_changes(*_versions(spark, d))


_COMMON = tuple(c for c in s.COLUMNS if c != "notes")


def _gaps(c):
    return (f"SELECT \"column\", count(*) - count({s.null_words('v')}) AS m FROM {c} GROUP BY 1")


@query("missing_changes", f"""{s.both_versions(s.cells(_COMMON, 'people', 'ca'),
                                               s.cells(_COMMON, 'people_v2', 'cb'))}
SELECT "column", a.m AS before, b.m AS after, b.m - a.m AS delta FROM ({_gaps('ca')}) a
JOIN ({_gaps('cb')}) b USING ("column") WHERE a.m <> b.m""")
def missing_changes(spark, d):
    return changes.missing_changes(*_versions(spark, d))


_SHIFT = ", ".join(f"round({f}, 4) AS {k}" for k, f in (
    ("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("max", "max(v)")))


@query("distribution_shift", f"""{s.both_versions(*_SIDES)}
SELECT "column", a.mean AS mean_before, b.mean AS mean_after, a.std AS std_before,
  b.std AS std_after, a.min AS min_before, b.min AS min_after, a.max AS max_before,
  b.max AS max_after, round(b.m - a.m, 4) AS mean_delta
FROM (SELECT "column", avg(v) AS m, {_SHIFT} FROM na GROUP BY 1) a
JOIN (SELECT "column", avg(v) AS m, {_SHIFT} FROM nb GROUP BY 1) b USING ("column")""")
def distribution_shift(spark, d):
    return changes.distribution_shift(*_versions(spark, d))


_CHANGED = f"""{_PEOPLE_PAIRED} SELECT "column", CASE WHEN a = 0 THEN 'added' ELSE 'removed' END
AS change, value FROM paired WHERE (a = 0) <> (b = 0)"""


@query("category_changes", _CHANGED)
def category_changes(spark, d):
    return changes.category_changes(*_versions(spark, d))


_SHOWN = """SELECT "column", CASE WHEN a = 0 THEN 'added' ELSE 'removed' END AS change,
count(*) AS total, array_to_string(list_sort(list(value))[1:20], ', ') AS "values"
FROM paired WHERE (a = 0) <> (b = 0) GROUP BY 1, 2"""


@query("category_changes_orders", f"""WITH {s.cells(('o_orderstatus', 'd'), '''(SELECT
o_orderstatus, CAST(o_totalprice AS VARCHAR) AS d FROM orders WHERE o_orderpriority = '1-URGENT')
''', 'ca')}, {s.cells(('o_orderstatus', 'd'), '''(SELECT o_orderstatus,
CAST(o_totalprice AS VARCHAR) AS d FROM orders WHERE o_orderpriority <> '1-URGENT')''', 'cb')},
{_paired('ca', 'cb')} {_SHOWN}""")
def category_changes_orders(spark, d):
    """The first values in order that only one group of orders has, and how many there are."""
    o = table(spark, d, "orders").select(
        "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("string").alias("d"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    keep = ["o_orderstatus", "d"]
    return changes.category_changes_shown(o.where(urgent).select(keep), o.where(
        ~urgent).select(keep)).withColumn("values", F.array_join("values", ", "))


@query("category_changes_documents", f"""WITH {s.cells(('source', 'text'), '''(SELECT source, text
FROM documents WHERE lang = 'en')''', 'ca')}, {s.cells(('source', 'text'), '''(SELECT source, text
FROM documents WHERE lang <> 'en')''', 'cb')}, {_paired('ca', 'cb')} {_SHOWN}""")
def category_changes_documents(spark, d):
    """Long texts: documents in English against all others."""
    docs, keep = table(spark, d, "documents"), ["source", "text"]
    english = F.col("lang") == "en"
    return changes.category_changes_shown(docs.where(english).select(keep), docs.where(
        ~english).select(keep)).withColumn("values", F.array_join("values", ", "))


@query("stored_changes", f"""{_PEOPLE_PAIRED}, {s.cells(_COMMON, 'people', 'aa')},
{s.cells(_COMMON, 'people_v2', 'bb')}, ra AS (SELECT count(*) AS n FROM people),
rb AS (SELECT count(*) AS n FROM people_v2)
SELECT 'rows' AS section, '__all__' AS "column", 'rows' AS item, CAST(ra.n AS VARCHAR) AS before,
  CAST(rb.n AS VARCHAR) AS after, CAST(rb.n - ra.n AS VARCHAR) AS delta FROM ra, rb
UNION ALL SELECT 'missing', "column", 'missing', CAST(a.m AS VARCHAR), CAST(b.m AS VARCHAR),
  CAST(b.m - a.m AS VARCHAR) FROM ({_gaps('aa')}) a JOIN ({_gaps('bb')}) b USING ("column")
  WHERE a.m <> b.m
UNION ALL SELECT 'categories', "column", change, NULL, "values", CAST(total AS VARCHAR)
  FROM ({_SHOWN})""")
def stored_changes(spark, d):
    """Two registered versions, compared by their kept states."""
    store = VersionStore(spark, scratch_path(spark, "states"))
    for version in _versions(spark, d):
        store.register("people", version)
    return store.changes("people", 1, 2).where("section IN ('rows', 'missing', 'categories')")


@query("change_summary")
def change_summary(spark, d):
    return changes.summary(*_versions(spark, d))
