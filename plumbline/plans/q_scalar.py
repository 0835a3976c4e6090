"""Row-local rules: normalisers and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.functions import dates, text
from plumbline.operators import repair
from plumbline.operators.cells import text_cells
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table
from plumbline.plans.registry import query

def _v():
    return F.col("value")


def _cells(spark, d, names=s.STRINGS):
    return text_cells(people(spark, d), list(names))


@query("null_normalise", f"""{s.people()}
SELECT id, {s.null_words('name')} AS name, {s.null_words('phone')} AS phone,
       {s.null_words('score_text')} AS score_text FROM people""")
def null_normalise(spark, d):
    return people(spark, d).select("id", *[
        text.null_normalise(F.col(c)).alias(c) for c in ("name", "phone", "score_text")])


def _junk(c):
    return f"CASE WHEN {s.folded(c)} IN {s.values(vocab.JUNK_REPAIR)} THEN NULL ELSE {c} END"


@query("junk_normalise", f"""{s.people()}
SELECT id, {_junk('name')} AS name, {_junk('phone')} AS phone, {_junk('score_text')} AS score_text
FROM people""")
def junk_normalise(spark, d):
    return people(spark, d).select("id", *[
        text.junk_normalise(F.col(c)).alias(c) for c in ("name", "phone", "score_text")])


@query("numeric_ratio", f"""{s.people(s.cells(s.STRINGS))}
SELECT "column", count(v) AS known, count({s.as_num('v')}) AS numbers,
       round(sum({s.as_num('v')}), 2) AS total,
       count({s.as_num('v')}) / CAST(count(v) AS DOUBLE) AS ratio FROM cells GROUP BY 1""")
def numeric_ratio(spark, d):
    n = text.as_num(_v())
    return _cells(spark, d).groupBy("column").agg(
        F.count(_v()).alias("known"), F.count(n).alias("numbers"),
        F.round(F.sum(n), 2).alias("total"), (F.count(n) / F.count(_v())).alias("ratio"))


_TEXT_DATE = """CASE o_orderkey % 7
  WHEN 0 THEN concat(y, '-', m, '-', dd) WHEN 1 THEN concat(y, '/', m, '/', dd)
  WHEN 2 THEN concat(m, '/', dd, '/', y) WHEN 3 THEN concat(dd, '.', m, '.', y)
  WHEN 4 THEN concat(dd, '-', m, '-', y) WHEN 5 THEN concat(y, '-02-30')
  ELSE concat('w', o_orderpriority) END"""
_PARTS = ("SELECT o_orderkey, o_orderpriority, o_orderdate, "
          "CAST(year(o_orderdate) AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m, "
          "CAST(day(o_orderdate) AS STRING) AS dd FROM {orders}")


def order_dates(spark, d):
    """Orders with their date as text in seven notations, two of them no dates."""
    return spark.sql(f"SELECT o_orderkey, {_TEXT_DATE} AS when_text FROM ({_PARTS})",
                     orders=table(spark, d, "orders"))


ORDER_DATES_CTE = (f"WITH parts AS ({_PARTS.replace('{orders}', 'orders')}), "
                   f"dated AS (SELECT o_orderkey, {_TEXT_DATE} AS when_text FROM parts)")


@query("date_parsing", f"""{ORDER_DATES_CTE}
SELECT o_orderkey, when_text, CAST({s.as_date('when_text')} AS DATE) AS parsed FROM dated""")
def date_parsing(spark, d):
    return order_dates(spark, d).select(
        "o_orderkey", "when_text", dates.as_date(F.col("when_text")).alias("parsed"))


@query("date_formats", f"""{s.people()}
SELECT {s.label('signup_date', vocab.DATE_LABELS_SCORE)} AS label, count(*) AS n
FROM people GROUP BY 1""")
def date_formats(spark, d):
    return people(spark, d).groupBy(dates.date_label(F.col("signup_date")).alias("label")).agg(
        F.count("*").alias("n"))


@query("date_formats_cause", f"""{ORDER_DATES_CTE}
SELECT {s.label('when_text', vocab.DATE_LABELS_CAUSE)} AS label, count(*) AS n
FROM dated GROUP BY 1""")
def date_formats_cause(spark, d):
    return order_dates(spark, d).groupBy(dates.date_label(
        F.col("when_text"), vocab.DATE_LABELS_CAUSE).alias("label")).agg(
            F.count("*").alias("n"))


@query("ambiguous_dates", f"""{s.people()}
SELECT signup_date, count(*) AS n FROM people WHERE {s.ambiguous('signup_date')} GROUP BY 1""")
def ambiguous_dates(spark, d):
    return (people(spark, d).where(dates.is_ambiguous(F.col("signup_date")))
            .groupBy("signup_date").agg(F.count("*").alias("n")))


@query("email_validity", f"""{s.people()}
SELECT count(email) AS known,
  count_if(NOT {s.match(s.strip('email'), vocab.EMAIL_STRICT)}) AS bad_strict,
  count_if(NOT {s.match(s.strip('email'), vocab.EMAIL_LENIENT)}) AS bad_lenient FROM people""")
def email_validity(spark, d):
    e = F.col("email")
    return people(spark, d).agg(
        F.count(e).alias("known"), F.count_if(~text.email_strict(e)).alias("bad_strict"),
        F.count_if(~text.email_lenient(e)).alias("bad_lenient"))


_LISTS = {"garbage": vocab.GARBAGE, "junk_anomaly": vocab.JUNK_ANOMALY,
          "junk_repair": vocab.JUNK_REPAIR, "sentinel": vocab.GARBAGE_SENTINEL}


@query("garbage_words", f"""{s.people(s.cells(s.STRINGS))}
SELECT "column", {', '.join(f"count_if({s.folded('v')} IN {s.values(w)}) AS {k}"
                            for k, w in _LISTS.items())} FROM cells GROUP BY 1""")
def garbage_words(spark, d):
    f = text.folded(_v())
    return _cells(spark, d).groupBy("column").agg(
        *[F.count_if(f.isin(*w)).alias(k) for k, w in _LISTS.items()])


@query("placeholders", f"""{s.people()}
SELECT count_if({s.folded('email')} IN {s.values(vocab.PLACEHOLDER_EMAILS_SCORE)}) AS emails,
       count_if({s.strip('signup_date')} IN {s.values(vocab.PLACEHOLDER_DATES)}) AS dates
FROM people""")
def placeholders(spark, d):
    return people(spark, d).agg(
        F.count_if(text.folded(F.col("email")).isin(*vocab.PLACEHOLDER_EMAILS_SCORE))
        .alias("emails"),
        F.count_if(text.strip(F.col("signup_date")).isin(*vocab.PLACEHOLDER_DATES))
        .alias("dates"))


def _canonical(c, table):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {s.folded(c)} {whens} ELSE {c} END"


@query("country_canonical", f"""{s.people()}
SELECT country, {_canonical('country', vocab.COUNTRY_MAP_CLEANING)} AS cleaned,
       {_canonical('country', vocab.COUNTRY_MAP_REPAIR)} AS suggested, count(*) AS n
FROM people GROUP BY 1, 2, 3""")
def country_canonical(spark, d):
    c = F.col("country")
    return people(spark, d).groupBy(
        "country", text.canonical(c, vocab.COUNTRY_MAP_CLEANING).alias("cleaned"),
        text.canonical(c, vocab.COUNTRY_MAP_REPAIR).alias("suggested")).agg(
            F.count("*").alias("n"))


def _title(c):
    return (f"array_to_string(list_transform(string_split({c}, ' '), "
            f"lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ')")


@query("text_casing", f"""SELECT p_partkey, {s.strip("concat('  ', p_name, ' ')")} AS trimmed,
  {_title('p_name')} AS titled, {_title('p_type')} AS type_titled, upper(p_name) AS uppered,
  lower(p_type) AS lowered FROM part""")
def text_casing(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", text.strip(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"),
        text.cased(n, "title").alias("titled"), text.cased(t, "title").alias("type_titled"),
        text.cased(n, "upper").alias("uppered"), text.cased(t, "lower").alias("lowered"))


_CARD = ("concat('4', lpad(CAST(o_orderkey AS STRING), 8, '0'), '-', "
         "lpad(CAST(o_custkey AS STRING), 7, '0'))")


@query("luhn", f"""WITH c AS (SELECT o_orderkey, {_CARD} AS card FROM orders)
SELECT o_orderkey, card, {s.luhn('card')} AS valid FROM c""")
def luhn(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_CARD} AS card").withColumn(
        "valid", text.luhn(F.col("card")))


@query("domain_range", f"""{s.people()}
SELECT 'age' AS "column", CAST(0 AS DOUBLE) AS lo, CAST(120 AS DOUBLE) AS hi,
       count_if(age < 0 OR age > 120) AS out_of_range FROM people
UNION ALL SELECT 'salary', CAST(0 AS DOUBLE), NULL, count_if(salary < 0) FROM people
UNION ALL SELECT 'score_text', CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), count_if({s.as_num('score_text')} < 0
  OR {s.as_num('score_text')} > 100) FROM people""")
def domain_range(spark, d):
    df = people(spark, d)
    return repair.out_of_range(repair.as_numbers(df, ["score_text"]))
