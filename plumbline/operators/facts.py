"""Row-local facts of every column, from one scan of all cells and one of the numeric ones.

Each fact is a conditional count per column.  Text predicates are computed once per distinct
value of repetitive columns and once per cell of the others, then counted in a
column-grouped aggregate with map-side combine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import dates, text
from plumbline.operators import pii, security
from plumbline.operators.cells import (
    TABLE, in_columns, names_of, number_cells, tally, text_cells, weighted_cells)
from plumbline.roles import col


def _role(df: DataFrame, *names: str) -> Column:
    return in_columns(c.name for c in roles.columns(df) if any(c.has(r) for r in names))


def text_facts(df: DataFrame, as_of: dt.date | None = None,
               repeated: list[str] | None = None) -> DataFrame:
    """One row per string column.

    column, rows, nulls, missing, garbage, sentinel, placeholders, numeric, email_bad,
    email_bad_lenient, date_unparseable, date_bad_year, date_future, date_ambiguous,
    date_non_iso, date_unlabelled, date_formats, cause_formats, date_like, age_bad,
    ambiguous_any, odd (flagged by name or content, dates apart).  Only cells in a date's shape
    reach the date parser.
    """
    names = names_of(df, "string")
    cells = _prepared(df, weighted_cells(df, names, repeated), F.lit(True))
    return text_view(cells.groupBy("column").agg(*_text_tallies(df, as_of, F.lit(True))))


def cell_facts(df: DataFrame, as_of: dt.date | None = None, repeated: list[str] | None = None,
               threats: bool = True, personal: bool = True) -> DataFrame:
    """All row-local counts of all columns from one pass over the cells, one wide row a column.

    text_view, security.from_tallies and pii.from_tallies read their frames off it; the row named
    cells.TABLE counts the table's rows, those without any value as nulls.
    """
    strings = in_columns(names_of(df, "string"))
    plain = pii.as_text(df) if personal else df.select(*[col(c.name) for c in roles.columns(df)])
    filled = F.coalesce(*[col(n).cast("string") for n in plain.columns]).isNotNull()
    plain = plain.withColumn(TABLE, F.when(filled, ""))
    names = plain.columns
    cells = _prepared(df, weighted_cells(plain, names, [*(repeated or []), TABLE]), strings)
    return cells.groupBy("column").agg(
        *_text_tallies(df, as_of, strings), tally(F.col("value").isNotNull()).alias("total"),
        *(security.tallies(strings) if threats else []), *(pii.tallies() if personal else []))


def text_view(counted: DataFrame) -> DataFrame:
    """text_facts of counted columns: counts per date notation become lists of notations."""
    def found(prefix, labels):
        return F.array_sort(F.filter(F.array(*[
            F.when(F.col(f"{prefix}{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(labels)
        ]), lambda x: x.isNotNull()))
    return counted.select(
        *_FACTS[:-4], found("score_", vocab.DATE_LABELS_SCORE).alias("date_formats"),
        found("cause_", vocab.DATE_LABELS_CAUSE).alias("cause_formats"), *_FACTS[-4:])


_FACTS = ("column", "rows", "nulls", "missing", "garbage", "sentinel", "placeholders", "numeric",
          "email_bad", "email_bad_lenient", "date_unparseable", "date_bad_year", "date_future",
          "date_ambiguous", "date_non_iso", "date_unlabelled", "date_like", "age_bad",
          "ambiguous_any", "odd")


def _prepared(df: DataFrame, cells: DataFrame, strings: Column) -> DataFrame:
    """Weighted cells with what several rules need; only text columns are worked on."""
    s = F.col("stripped")
    any_date = _role(df, "date", "cause_date")
    return (cells.withColumn("stripped", F.when(strings, text.strip(F.col("value"))))
            .withColumn("folded", F.lower("stripped"))
            .withColumn("ambiguous", s.rlike(vocab.AMBIGUOUS_DATE))
            .withColumn("parsed", F.when(~F.col("ambiguous"), dates.as_date(s)))
            .withColumn("score_label", F.when(
                _role(df, "date"), dates.date_label(s, vocab.DATE_LABELS_SCORE)))
            .withColumn("cause_label", F.when(
                any_date, dates.date_label(s, vocab.DATE_LABELS_CAUSE))))


def _text_tallies(df: DataFrame, as_of: dt.date | None, strings: Column) -> list[Column]:
    as_of_col = F.lit(as_of) if as_of else F.current_date()
    v, f, s, d = (F.col(n) for n in ("value", "folded", "stripped", "parsed"))
    email, date = _role(df, "email"), _role(df, "date")
    any_date = _role(df, "date", "cause_date")
    future_ok = in_columns(c.name for c in roles.columns(df)
                           if roles.norm(c.name) in vocab.FUTURE_ALLOWED_NAMES)
    known = strings & v.isNotNull()
    lo, hi = vocab.AGE_RANGE
    age = text.as_num(v)
    settled = any_date & known & ~F.col("ambiguous")
    year = F.year(d)
    bad_year = (year < 1900) | (year > F.year(as_of_col) + 1)
    tested = ~_role(df, "id")  # columns whose values may be anomalous
    odd = ((_role(df, "numeric_intent") & ~text.is_num(v) & ~f.isin("", "nan"))
           | f.isin(*vocab.JUNK_ANOMALY) | (email & f.isin(*vocab.PLACEHOLDER_EMAILS_ANOMALY))
           | (_role(df, "short_text") & (F.length(v) > vocab.SHORT_TEXT_LIMIT)))
    return [
        F.sum("n").alias("rows"),
        tally(v.isNull()).alias("nulls"),
        tally(v.isNull() | strings & v.isin(*vocab.NULL_PATTERNS)).alias("missing"),
        tally(f.isin(*vocab.GARBAGE)).alias("garbage"),
        tally(f.isin(*vocab.GARBAGE_SENTINEL)).alias("sentinel"),
        tally((email & f.isin(*vocab.PLACEHOLDER_EMAILS_SCORE))
              | (date & s.isin(*vocab.PLACEHOLDER_DATES))).alias("placeholders"),
        tally(strings & text.is_num(v)).alias("numeric"),
        tally(email & known & ~s.rlike(vocab.EMAIL_STRICT)).alias("email_bad"),
        tally(email & known & ~s.rlike(vocab.EMAIL_LENIENT)).alias("email_bad_lenient"),
        tally(settled & d.isNull()).alias("date_unparseable"),
        tally(settled & d.isNotNull() & bad_year).alias("date_bad_year"),
        tally(settled & d.isNotNull() & ~bad_year & (d > as_of_col) & ~future_ok)
        .alias("date_future"),
        tally(any_date & F.col("ambiguous")).alias("date_ambiguous"),
        tally(settled & d.isNotNull() & ~s.rlike(vocab.ISO_DATE)).alias("date_non_iso"),
        tally(any_date & known & (F.col("ambiguous") | d.isNotNull())
              & F.col("cause_label").isNull()).alias("date_unlabelled"),
        tally(F.col("ambiguous") | d.isNotNull()).alias("date_like"),
        tally(strings & _role(df, "age") & ((age < lo) | (age > hi))).alias("age_bad"),
        tally(F.col("ambiguous")).alias("ambiguous_any"),
        tally(tested & known & odd).alias("odd"),
        *[tally(F.col(f"{kind}_label") == label).alias(f"{kind}_{i}")
          for kind, labels in (("score", vocab.DATE_LABELS_SCORE),
                               ("cause", vocab.DATE_LABELS_CAUSE))
          for i, (_, label) in enumerate(labels)]]


def flagged_columns(df: DataFrame, facts: DataFrame, as_dates: list[str]) -> list[str]:
    """Text columns with values that anomalies.text_flags finds.  facts: pinned text_facts."""
    ids = {c.name for c in roles.columns(df) if c.has("id")}
    return [r["column"] for r in facts.collect() if r["column"] not in ids and (
        r["odd"] or r["column"] in as_dates and (
            r["ambiguous_any"] or r["date_like"] < r["rows"] - r["nulls"]))]


def number_facts(df: DataFrame) -> DataFrame:
    """One row per numeric column: column, rows, nulls, n, mean, std, age_bad (outside the
    age range)."""
    v = F.col("value")
    lo, hi = vocab.AGE_RANGE
    return number_cells(df, names_of(df, "numeric")).groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if(v.isNull()).alias("nulls"),
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.count_if(_role(df, "age") & ((v < lo) | (v > hi))).alias("age_bad"))


def date_columns(df: DataFrame, text: DataFrame) -> list[str]:
    """String columns treated as dates: by name, or because most cells look like dates.

    text: the pinned text_facts of df.
    """
    named = [c.name for c in roles.columns(df) if c.kind == "string" and c.has("date")]
    ids = [c.name for c in roles.columns(df) if c.has("id")]
    auto = text.where(F.col("rows") > F.col("nulls")).where(
        F.col("date_like") >= vocab.DATE_LIKE_SHARE * (F.col("rows") - F.col("nulls")))
    return named + [r["column"] for r in auto.select("column").collect()
                    if r["column"] not in named and r["column"] not in ids]


def case_variants(df: DataFrame, role: str) -> DataFrame:
    """column, raw, canonical: distinct spellings before and after trim + lower.

    Distinct spellings are found first; a status column has few of them.
    """
    names = names_of(df, "string", role)
    distinct = text_cells(df, names).where(F.col("value").isNotNull()).distinct()
    folded = (distinct.groupBy("column", text.folded(F.col("value")).alias("f"))
              .agg(F.count("*").alias("n")))
    return folded.groupBy("column").agg(F.sum("n").alias("raw"),
                                        F.count("*").alias("canonical"))
