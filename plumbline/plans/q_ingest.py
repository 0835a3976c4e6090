"""Readers, writers and checks on raw input."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import vocab
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table
from plumbline.plans.registry import query
from plumbline.plans.session import scratch_path
from plumbline.sources import delimiters, readers, writers


# ship the worker function by value: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _na(c):
    return f"CASE WHEN {c} IN {s.values(vocab.READER_NA)} THEN NULL ELSE {c} END AS {c}"


_READ_BACK = ", ".join(_na(c) if c in s.STRINGS else c for c in s.COLUMNS)


@query("csv_ingest", f"{s.people()} SELECT {_READ_BACK} FROM people")
def csv_ingest(spark, d):
    """Written as CSV, read back with null tokens removed and types inferred."""
    path = scratch_path(spark, "people-csv")
    writers.write(people(spark, d), path, "csv")
    return readers.read(spark, path, "csv")


@query("json_ingest", f"{s.people()} SELECT {', '.join(s.COLUMNS)} FROM people")
def json_ingest(spark, d):
    path = scratch_path(spark, "people-json")
    writers.write(people(spark, d), path, "json")
    return readers.read(spark, path, "json", lines=True).select(*s.COLUMNS)


_WHOLE = r"regexp_matches(v, '^\s*[+-]?[0-9]+\s*$')"


@query("csv_wide_integers", """SELECT CAST(9223372036854775800::DECIMAL(20, 0) + o_orderkey AS VARCHAR) AS id,
  CAST(9007199254740993 + o_orderkey AS VARCHAR) AS long_id, o_custkey FROM orders""")
def csv_wide_integers(spark, d):
    """Whole numbers beyond double and beyond bigint, through CSV."""
    path = scratch_path(spark, "wide-csv")
    writers.write(table(spark, d, "orders").selectExpr(
        "CAST(9223372036854775800 AS DECIMAL(20, 0)) + o_orderkey AS id",
        "9007199254740993 + o_orderkey AS long_id", "o_custkey"), path, "csv")
    return readers.read(spark, path, "csv", multi_line=False).select(
        F.col("id").cast("string"), F.col("long_id").cast("string"), "o_custkey")


_BROKEN = ("concat(c_name, chr(10), c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN concat(chr(10), "
           "'\"quoted\", too') ELSE '' END)")


@query("csv_multiline", f"SELECT c_custkey, {_BROKEN} AS remark FROM customer")
def csv_multiline(spark, d):
    """Texts with line breaks and quotes, through CSV."""
    path = scratch_path(spark, "multiline-csv")
    writers.write(table(spark, d, "customer").selectExpr(
        "c_custkey", f"{_BROKEN} AS remark"), path, "csv")
    return readers.read(spark, path, "csv")


@query("csv_ragged", """SELECT count(*) AS records,
  count(*) FILTER (WHERE o_orderkey % 7 = 0) AS surplus FROM orders""")
def csv_ragged(spark, d):
    """Records with more fields than the header."""
    path = scratch_path(spark, "ragged-csv")
    lines = table(spark, d, "orders").selectExpr("concat(o_orderkey, ',', CASE o_orderkey % 7 "
                                                 "WHEN 0 THEN 'a,b' WHEN 1 THEN '' ELSE 'a' END) AS l")
    # every file starts with the header, as the writer of a partitioned export leaves it
    lines.mapInArrow(_with_header, "l string").write.text(path)
    return readers.csv_records(spark, path)


_EXTRA = "[0, 1, 15, 16, 17, 40][{}]"


@query("csv_surplus", f"""SELECT count(*) AS records, count(*) FILTER (WHERE
  {_EXTRA.format('o_orderkey % 6 + 1')} > 0 AND o_orderkey % 4 > 0) AS surplus FROM orders""")
def csv_surplus(spark, d):
    """Records with 1 to 40 further fields, of which the last one may hold a value."""
    path = scratch_path(spark, "surplus-csv")
    # two fields as the header has them, then empty ones, then a value, a quoted one or none
    lines = table(spark, d, "orders").selectExpr(
        "concat(o_orderkey, ',\"a, \"\"b\"\"\"', repeat(',', array(0, 1, 15, 16, 17, 40)"
        "[o_orderkey % 6]), CASE WHEN array(0, 1, 15, 16, 17, 40)[o_orderkey % 6] = 0 THEN '' "
        "ELSE array('', 'x', '\"x, y\"', ' ')[o_orderkey % 4] END) AS l")
    lines.mapInArrow(_with_header, "l string").write.text(path)
    return readers.csv_records(spark, path)


def _with_header(batches):
    for i, b in enumerate(batches):
        if not i:
            yield pa.RecordBatch.from_arrays([pa.array(["key,flag"])], names=["l"])
        yield b


@query("json_array_ingest", f"{s.people()} SELECT {', '.join(s.COLUMNS)} FROM people")
def json_array_ingest(spark, d):
    """One JSON array, as web services return it."""
    path = scratch_path(spark, "people-array")
    people(spark, d).agg(F.to_json(F.collect_list(F.struct(*s.COLUMNS)), {
        "ignoreNullFields": "false"})).coalesce(1).write.text(path)
    return readers.read(spark, path, "json").select(*s.COLUMNS)


@query("inferred_types", f"""{s.people(s.cells())}
SELECT "column", count(v) AS non_null, CASE
  WHEN count(v) = 0 THEN 'string'
  WHEN count(TRY_CAST(v AS BIGINT)) FILTER (WHERE {_WHOLE}) = count(v) THEN 'bigint'
  WHEN count(TRY_CAST(v AS DECIMAL(38, 0))) FILTER (WHERE {_WHOLE}) = count(v)
    THEN 'decimal(38,0)'
  WHEN count(v) FILTER (WHERE {_WHOLE}) = count(v) THEN 'string'
  WHEN count_if({s.is_num('v')}) = count(v) THEN 'double'
  WHEN count_if(v IN ('true', 'false', 'True', 'False', 'TRUE', 'FALSE')) = count(v)
    THEN 'boolean' ELSE 'string' END AS inferred_type
FROM cells GROUP BY 1""")
def inferred_types(spark, d):
    df = people(spark, d)
    return readers.inferred_types(df.select([F.col(c).cast("string") for c in df.columns]))


@query("record_quality", """WITH r AS (SELECT CASE WHEN event_id % 13 = 0
    THEN substr(props, 1, 4) ELSE props END AS raw FROM events)
SELECT count(*) AS records, count_if(NOT json_valid(raw)) AS corrupt,
       count_if(json_valid(raw)) AS usable FROM r""")
def record_quality(spark, d):
    raw = table(spark, d, "events").selectExpr(
        "CASE WHEN event_id % 13 = 0 THEN substr(props, 1, 4) ELSE props END AS raw")
    return readers.record_quality(raw, T.StructType().add("k", "long"), "raw")


_LINE = """CASE WHEN o_orderkey % 50 = 7 THEN concat(CAST(o_orderkey AS STRING), ';',
  o_orderstatus, ';', o_orderpriority) WHEN o_orderkey % 90 = 8 THEN concat(o_orderstatus, '|',
  o_orderpriority, '|', CAST(o_custkey AS STRING), ',x') ELSE concat(
  CAST(o_orderkey AS STRING), ',', CAST(o_custkey AS STRING), ',', o_orderstatus, ',',
  o_orderpriority) END"""


def _lines(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_LINE} AS value")


def _hits(ch):
    return f"(length(v) - length(replace(v, '{ch}', '')))"


_DELIMS = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{name}' AS delimiter, k, {_hits(ch)} AS hits FROM lines"""
    for i, (ch, name) in enumerate(vocab.DELIMITERS, 1))
_LINES_CTE = (f"WITH lines AS (SELECT o_orderkey AS k, {_LINE} AS v FROM orders), "
              f"hits AS ({_DELIMS}), totals AS (SELECT position, delimiter, "
              "CAST(sum(hits) AS BIGINT) AS total, count_if(hits >= 2) AS dense_lines "
              "FROM hits GROUP BY 1, 2), best AS (SELECT delimiter AS p FROM totals "
              "ORDER BY total DESC, position LIMIT 1)")


@query("delimiter_totals", f"""{_LINES_CTE}
SELECT delimiter, total, dense_lines, (SELECT count(*) FROM lines) AS lines FROM totals""")
def delimiter_totals(spark, d):
    return delimiters.delimiter_totals(_lines(spark, d)).drop("position")


@query("delimiter_report", f"""{_LINES_CTE}
SELECT (SELECT p FROM best) AS "primary",
  CAST(sum(dense_lines) FILTER (WHERE delimiter <> (SELECT p FROM best)) AS BIGINT) > 0 AS mixed,
  string_agg(delimiter, ',' ORDER BY delimiter)
    FILTER (WHERE dense_lines > 0 OR delimiter = (SELECT p FROM best)) AS delimiters_found,
  CAST(sum(dense_lines) FILTER (WHERE delimiter <> (SELECT p FROM best)) AS BIGINT)
    AS lines_affected, (SELECT count(*) FROM lines) AS lines FROM totals""")
def delimiter_report(spark, d):
    return delimiters.delimiter_report(_lines(spark, d))


@query("delimiter_lines", f"""{_LINES_CTE}
SELECT k AS o_orderkey, delimiter, hits FROM hits
WHERE hits >= 2 AND delimiter <> (SELECT p FROM best)""")
def delimiter_lines(spark, d):
    return delimiters.affected_lines(_lines(spark, d), "o_orderkey")


@query("sample_rows")
def sample_rows(spark, d):
    """The deterministic 50,000-row sample used before a profile."""
    return readers.sample_exact(table(spark, d, "lineitem"))


@query("sample_properties", """SELECT least(count(*), 5000) AS rows, 0::BIGINT AS strangers,
  true AS repeatable, true AS fraction_fits FROM lineitem""")
def sample_properties(spark, d):
    """Samples hold the rows asked for, all from the table, and the same ones each time."""
    t = table(spark, d, "lineitem")
    one = readers.sample_exact(t, 5000)
    again = readers.sample_exact(t.repartition(5), 5000)
    part = readers.sample_fraction(t, 0.1).agg(F.count("*").alias("p"))

    def summed(df):
        return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).scalar()
    return one.agg(
        F.count("*").alias("rows"), one.exceptAll(t).agg(F.count("*")).scalar().alias("strangers"),
        (summed(one) == summed(again)).alias("repeatable"),
        (F.abs(part.scalar() / t.agg(F.count("*")).scalar() - 0.1) < 0.03).alias("fraction_fits"))


@query("sample_fraction")
def sample_fraction(spark, d):
    return readers.sample_fraction(table(spark, d, "lineitem"), 0.1)
