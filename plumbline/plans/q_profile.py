"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.operators.frequent import frequent_values, modes
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table, view
from plumbline.plans.registry import query

LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax")
LINE_ALL = LINE + ("l_returnflag", "l_linestatus", "l_shipdate")


def _rounded(df, digits, *names):
    return df.select([F.round(c, digits).alias(c) if c in names else F.col(c)
                      for c in df.columns])


@query("table_shape", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def table_shape(spark, d):
    df = table(spark, d, "lineitem")
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


_MISSING = f"""SELECT "column", count(*) AS rows, count(*) - count({s.null_words('v')})
  AS missing_count, round((count(*) - count({s.null_words('v')})) * 100.0 / count(*), 2)
  AS missing_pct FROM cells GROUP BY 1"""


@query("profile_missing", f"{s.people(s.cells())} {_MISSING}")
def profile_missing(spark, d):
    return profile.missing(people(spark, d))


@query("missing_share", f"""{s.people(s.cells(), f"m AS ({_MISSING})")}
SELECT CAST(sum(missing_count) AS BIGINT) AS missing_cells,
       CAST(sum(rows) AS BIGINT) AS total_cells,
       round(sum(missing_count) * 100.0 / sum(rows), 6) AS missing_pct FROM m""")
def missing_share(spark, d):
    return _rounded(profile.missing_share(people(spark, d)), 6, "missing_pct")


@query("null_rows", f"""{s.people()}
SELECT count_if(name IS NULL AND email IS NULL) AS null_rows, count(*) AS rows FROM people""")
def null_rows(spark, d):
    return profile.null_rows(people(spark, d).select("name", "email"))


_DUP = """SELECT (SELECT count(*) FROM people) AS rows,
  (SELECT count(*) FROM people) - (SELECT count(*) FROM (SELECT DISTINCT * FROM people))
    AS exact_dups,
  (SELECT count(*) FROM people) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (id)
    FROM people)) AS logical_dups"""


@query("duplicates", f"""{s.people(f"u AS ({_DUP})")}
SELECT rows, exact_dups, round(exact_dups * 100.0 / rows, 2) AS exact_dup_pct, logical_dups,
       round(logical_dups * 100.0 / rows, 2) AS logical_dup_pct, 'id' AS id_columns FROM u""")
def duplicates(spark, d):
    return profile.duplicates(people(spark, d)).withColumn(
        "id_columns", F.array_join("id_columns", ","))


@query("duplicates_logical", """WITH t AS (SELECT event_id AS id, user_id, event_type,
  CAST(floor(value) AS BIGINT) AS v FROM events)
SELECT (SELECT count(*) FROM t) AS rows,
  (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS exact_dups,
  (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, v
    FROM t)) AS logical_dups""")
def duplicates_logical(spark, d):
    t = table(spark, d, "events").selectExpr(
        "event_id AS id", "user_id", "event_type", "CAST(floor(value) AS BIGINT) AS v")
    return profile.duplicates(t).select("rows", "exact_dups", "logical_dups")


@query("distinct_counts", f"""{s.people(s.cells())}
SELECT "column", count(DISTINCT {s.null_words('v')}) AS unique_count FROM cells GROUP BY 1""")
def distinct_counts(spark, d):
    return profile.distinct_counts(profile.value_histogram(people(spark, d)))


@query("distinct_counts_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM lineitem"
    for c in LINE_ALL))
def distinct_counts_lineitem(spark, d):
    return profile.unique_counts(table(spark, d, "lineitem", wide=True))


@query("distinct_counts_approx")
def distinct_counts_approx(spark, d):
    return profile.approx_distinct_counts(table(spark, d, "lineitem"))


_STATS = """SELECT "column", count(v) AS n, min(v) AS min, max(v) AS max,
  round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
  round(skewness(v), 3) AS skewness, round(kurtosis(v), 3) AS kurtosis FROM nums GROUP BY 1"""


def _stats(df):
    return _rounded(_rounded(profile.numeric_stats(df), 4, "mean", "std"), 3, "skewness",
                    "kurtosis")


_BIG = "SELECT o_orderkey + 9007199254740993 AS big, o_custkey, o_orderdate FROM orders"


@query("profile_extremes", f"""WITH t AS ({_BIG}), cells AS (
  SELECT 'big' AS "column", CAST(min(big) AS VARCHAR) AS min_value,
         CAST(max(big) AS VARCHAR) AS max_value FROM t
  UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR)
  FROM t
  UNION ALL SELECT 'o_orderdate', CAST(min(o_orderdate) AS VARCHAR),
         CAST(max(o_orderdate) AS VARCHAR) FROM t) SELECT * FROM cells""")
def profile_extremes(spark, d):
    """Extremes of numbers that a double cannot tell apart."""
    return profile.extremes(view(spark, d, _BIG, "orders"))


@query("profile_numeric", f"WITH {s.numbers(LINE, 'lineitem')} {_STATS}")
def profile_numeric(spark, d):
    return _stats(table(spark, d, "lineitem"))


@query("profile_numeric_people", f"{s.people(s.numbers(s.NUMBERS, 'people'))} {_STATS}")
def profile_numeric_people(spark, d):
    return _stats(people(spark, d))


_QUANT = """SELECT "column", count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q_25,
  round(quantile_cont(v, 0.5), 6) AS q_50, round(quantile_cont(v, 0.75), 6) AS q_75
FROM nums WHERE v IS NOT NULL GROUP BY 1"""


@query("quantiles", f"WITH {s.numbers(LINE, 'lineitem')} {_QUANT}")
def quantiles(spark, d):
    return _rounded(exact_quantiles(table(spark, d, "lineitem"), list(LINE)), 6,
                    "q_25", "q_50", "q_75")


@query("quantiles_narrowing", f"WITH {s.numbers(('o_totalprice', 'o_custkey'), 'orders')} "
       f"{_QUANT}")
def quantiles_narrowing(spark, d):
    """The same through sketch-and-count narrowing, the way beyond the size bound."""
    return _rounded(exact_quantiles(table(spark, d, "orders"), ["o_totalprice", "o_custkey"],
                                    exact_limit=500), 6, "q_25", "q_50", "q_75")


_HIST = f"""hist AS (SELECT "column", {s.null_words('v')} AS value, count(*) AS n FROM cells
  WHERE {s.null_words('v')} IS NOT NULL GROUP BY 1, 2)"""
_TOP = """SELECT "column", rank, value, n FROM (SELECT "column", value, n,
  row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM hist)
WHERE rank <= 10"""


@query("top_values", f"{s.people(s.cells(s.STRINGS), _HIST)} {_TOP}")
def top_values(spark, d):
    return frequent_values(profile.normalised(people(spark, d)), list(s.STRINGS), 10)


@query("top_values_lineitem",
       f"WITH {s.cells(('l_returnflag', 'l_linestatus', 'l_partkey'), 'lineitem')}, {_HIST} "
       f"{_TOP}")
def top_values_lineitem(spark, d):
    return frequent_values(profile.normalised(table(spark, d, "lineitem")),
                           ["l_returnflag", "l_linestatus", "l_partkey"], 10)


_TEXTS = ("text", "lang", "source")
_DOC_CELLS = s.cells(_TEXTS, "documents")


@query("top_values_documents", f"WITH {_DOC_CELLS}, {_HIST} {_TOP}")
def top_values_documents(spark, d):
    """Whole texts among the columns: only the winners' texts are read back."""
    return frequent_values(profile.normalised(table(spark, d, "documents")), list(_TEXTS), 10)


@query("top_values_proposed", f"WITH {_DOC_CELLS}, {_HIST} {_TOP}")
def top_values_proposed(spark, d):
    """The same with candidates proposed by sketches."""
    return frequent_values(profile.normalised(table(spark, d, "documents")), list(_TEXTS), 10,
                           propose=True)


@query("mode", f"""{s.people(s.cells(s.STRINGS), _HIST)}
SELECT "column", value AS mode, n FROM (SELECT *, row_number() OVER (
  PARTITION BY "column" ORDER BY n DESC, value) AS r FROM hist) WHERE r = 1""")
def mode(spark, d):
    return modes(profile.normalised(people(spark, d)), list(s.STRINGS))


@query("categorical_flags", f"""{s.people(s.cells(s.STRINGS), _HIST)}
SELECT "column", count(*) AS unique_count,
       count(*) < greatest(10.0, (SELECT count(*) FROM people) * 0.05)
         AS is_potentially_categorical FROM hist GROUP BY 1""")
def categorical_flags(spark, d):
    df = people(spark, d)
    return profile.categorical_flags(df, profile.value_histogram(df, list(s.STRINGS)))


_SAMPLED = [c for c in s.COLUMNS if c != "id"]
_SAMPLE_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", id, {s.null_words(f'CAST({c} AS VARCHAR)')} AS v FROM people"
    for c in _SAMPLED if c != "salary")


@query("sample_values", f"""{s.people(f"k AS ({_SAMPLE_CELLS})")}
SELECT "column", rank, v AS value FROM (SELECT "column", v, row_number() OVER (
  PARTITION BY "column" ORDER BY id) AS rank FROM k WHERE v IS NOT NULL) WHERE rank <= 5""")
def sample_values(spark, d):
    return profile.sample_values(people(spark, d).drop("salary"), ["id"])


@query("profile_table", f"""{s.people(s.cells(), s.numbers(s.NUMBERS, 'people'), _HIST,
                                      f"m AS ({_MISSING})",
                                      "st AS (" + _STATS + ")", "qt AS (" + _QUANT + ")")}
SELECT m."column", m.rows, m.missing_count, m.missing_pct,
  (SELECT count(*) FROM hist h WHERE h."column" = m."column") AS unique_count,
  st.mean, st.std, qt.q_25 AS q1, qt.q_50 AS median, qt.q_75 AS q3
FROM m LEFT JOIN st ON st."column" = m."column" LEFT JOIN qt ON qt."column" = m."column" """)
def profile_table(spark, d):
    p = profile.profile(people(spark, d)).select(
        "column", "rows", "missing_count", "missing_pct", "unique_count", "mean", "std", "q1",
        "median", "q3")
    return _rounded(_rounded(p, 4, "mean", "std"), 6, "q1", "median", "q3")


@query("profile_full")
def profile_full(spark, d):
    """Every profile field, nested ones included, for the widest table."""
    return profile.profile(table(spark, d, "lineitem", wide=True))
