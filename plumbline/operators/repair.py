"""Repair suggestions measured on the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import dates, text
from plumbline.operators import frequent, profile
from plumbline.operators.cells import (
    TABLE, in_columns, number_cells, pin, small_frame, tally, text_cells, together,
    weighted_cells)
from plumbline.operators.quantiles import exact_quantiles
from plumbline.roles import col

SUGGESTION = ("column", "issue_type", "action", "affected", "fill_value", "detail")


def _columns(df: DataFrame, kind: str, *wanted: str) -> list[str]:
    return [c.name for c in roles.columns(df) if c.kind == kind and not c.has("id")
            and (not wanted or any(c.has(r) for r in wanted))]


def text_counts(df: DataFrame) -> DataFrame:
    """column, rows, known, junk, missing, numeric, invalid_text, email_bad, date_bad,
    date_non_iso for every string column except ids."""
    v, s, f = F.col("value"), F.col("s"), F.col("f")
    email, date = in_columns(_columns(df, "string", "email")), in_columns(
        _columns(df, "string", "date"))
    cells = (weighted_cells(df, _columns(df, "string")).withColumn("s", text.strip(v))
             .withColumn("f", F.lower("s")).withColumn("junk", f.isin(*vocab.JUNK_REPAIR))
             .withColumn("iso", F.when(date, s.rlike(vocab.ISO_DATE)))
             .withColumn("dated", F.when(date & ~F.col("iso"),
                                         s.rlike(vocab.AMBIGUOUS_DATE)
                                         | dates.as_date(v).isNotNull())))
    return cells.groupBy("column").agg(
        F.sum("n").alias("rows"), tally(v.isNotNull()).alias("known"),
        tally(F.col("junk")).alias("junk"),
        tally(v.isNull() | F.col("junk")).alias("missing"),
        tally(text.is_num(v)).alias("numeric"),
        tally(~text.is_num(v) & ~F.col("junk")).alias("invalid_text"),
        tally(email & ~s.rlike(vocab.EMAIL_LENIENT)).alias("email_bad"),
        tally(~F.col("dated")).alias("date_bad"),
        tally(F.col("dated")).alias("date_non_iso"))


def numeric_intent(df: DataFrame, counts: DataFrame) -> list[str]:
    """String columns that are mostly numbers."""
    share = F.col("numeric") / F.greatest(F.col("known"), F.lit(1))
    return [r["column"] for r in
            counts.where(share >= vocab.MIXED_TYPE_SHARE).select("column").collect()]


def as_numbers(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """All numeric-intent columns of df as doubles."""
    out = [col(n).cast("double").alias(n) for n in _columns(df, "numeric")]
    return df.select(out + [text.as_num(col(n)).alias(n) for n in text_columns])


def out_of_range(numbers: DataFrame, rules=vocab.DOMAIN_RULES_REPAIR) -> DataFrame:
    """column, lo, hi, out_of_range by the first rule whose keyword the name contains."""
    limits = [(n, float(r[0]), None if r[1] is None else float(r[1]))
              for n in numbers.columns if (r := roles.domain_rule(n, rules))]
    table = small_frame(numbers.sparkSession, limits, "column string, lo double, hi double")
    v = F.col("value")
    return (number_cells(numbers, [n for n, _, _ in limits]).join(F.broadcast(table), "column")
            .groupBy("column", "lo", "hi")
            .agg(F.count_if((v < F.col("lo")) | (v > F.col("hi"))
                            | (F.col("hi").isNull() & (v < F.col("lo")))).alias("out_of_range")))


def fills(df: DataFrame, numbers: DataFrame, counts: DataFrame, intent: list[str]) -> DataFrame:
    """column, strategy, fill_value, missing, missing_pct for columns with missing cells."""
    numeric = _columns(df, "numeric")
    gaps = counts.select("column", "rows", "missing")
    others = _columns(df, "other")
    nulls = number_cells(df, numeric).select("column", F.col("value").isNull().alias("gap")).union(
        text_cells(df, others).select("column", F.col("value").isNull().alias("gap"))).groupBy(
        "column").agg(F.count("*").alias("rows"), F.count_if("gap").alias("missing"))
    gaps = pin(gaps.unionByName(nulls).where("missing > 0"))
    names = [r["column"] for r in gaps.collect()]
    number_names = [n for n in names if n in numbers.columns]
    words = [n for n in names if n not in numbers.columns]
    clean = df.select([col(n) if n in others else text.junk_normalise(col(n)).alias(n)
                       for n in words]) if words else df
    moments, modes = together(
        lambda: pin(profile.numeric_stats(numbers, number_names)),
        lambda: pin(frequent.modes(clean, words)))
    known = {r["column"]: r["n"] for r in moments.collect()}
    mid = exact_quantiles(numbers, number_names, (0.5,), counts=known)
    skewed = F.abs(F.coalesce("skewness", F.lit(0.0))) > vocab.SKEW_FOR_MEDIAN
    chosen = moments.where("n > 1").join(mid.drop("n"), "column").select(
        "column", F.when(skewed, "median").otherwise("mean").alias("strategy"),
        F.round(F.when(skewed, F.col("q_50")).otherwise(F.col("mean")), 2).cast("string")
        .alias("fill_value"))
    chosen = chosen.unionByName(modes.select(
        "column", F.lit("mode").alias("strategy"), F.col("mode").alias("fill_value")))
    return gaps.join(chosen, "column").withColumn(
        "missing_pct", F.round(F.col("missing") * 100.0 / F.col("rows"), 1))


def country_synonyms(df: DataFrame, skip: list[str]) -> DataFrame:
    """column, value, canonical: spellings to replace; only known ones leave the scan."""
    names = [c.name for c in roles.columns(df) if c.kind == "string" and not c.has("id")
             and not c.has("date") and not c.has("email") and c.name not in skip]
    canonical = F.try_element_at(F.create_map(*[
        F.lit(x) for kv in vocab.COUNTRY_MAP_REPAIR.items() for x in kv]),
        text.folded(F.col("value")))
    return (text_cells(df, names).withColumn("canonical", canonical)
            .where(F.col("canonical").isNotNull() & (F.col("value") != F.col("canonical")))
            .distinct())


def suggest(df: DataFrame) -> DataFrame:
    """All suggestions for df: column, issue_type, action, affected, fill_value, detail."""
    none = F.lit(None).cast("string")

    def rows(frame, condition, issue, action, affected, fill=none, detail=none):
        a = F.lit(action) if isinstance(action, str) else action
        return frame.where(condition).select(
            "column", F.lit(issue).alias("issue_type"), a.alias("action"),
            affected.cast("bigint").alias("affected"), fill.alias("fill_value"),
            detail.alias("detail"))

    counts, dups = together(lambda: pin(text_counts(df)), lambda: pin(profile.duplicates(df)))
    intent = numeric_intent(df, counts)
    numbers = as_numbers(df, intent)
    is_number = in_columns(intent)
    filled, ranged, synonyms = together(
        lambda: pin(fills(df, numbers, counts, intent)),
        lambda: pin(out_of_range(numbers)),
        lambda: pin(country_synonyms(df, intent).groupBy("column").agg(
            F.count("*").alias("n"))))
    c = F.col
    valid = F.when(c("hi").isNull(), F.format_string(">= %.0f", "lo")).otherwise(
        F.format_string("%.0f to %.0f", "lo", "hi"))
    parts = [
        rows(dups.withColumn("column", F.lit(TABLE)), "logical_dups > 0", "duplicates",
             "remove_duplicates", c("logical_dups")),
        rows(counts, "junk > 0", "garbage_values", "fix_junk", c("junk")),
        rows(counts, is_number & (c("invalid_text") > 0), "invalid_type", "fix_mixed_types",
             c("invalid_text")),
        rows(ranged, "out_of_range > 0", "out_of_range", "fix_range", c("out_of_range"),
             detail=valid),
        rows(filled, F.lit(True), "missing_values", F.concat(F.lit("fill_"), c("strategy")),
             c("missing"), c("fill_value"), c("missing_pct").cast("string")),
        rows(counts, "email_bad > 0", "invalid_emails", "flag_emails", c("email_bad")),
        rows(counts, "date_bad > 0", "invalid_dates", "fix_dates", c("date_bad")),
        rows(counts, "date_non_iso > 0", "inconsistent_dates", "standardize_dates",
             c("date_non_iso")),
        rows(synonyms, F.lit(True), "categorical_synonyms", "normalize_categories", c("n")),
        rows(filled, "missing_pct >= 50", "high_missing_rate", "review_column", c("missing"),
             detail=c("missing_pct").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gated(df: DataFrame, score_value: float, gate: float = vocab.CLEANING_GATE) -> DataFrame:
    """No suggestions for a table that scores above the gate."""
    if score_value > gate:
        return small_frame(df.sparkSession, [], "column string, issue_type string, "
                           "action string, affected bigint, fill_value string, detail string")
    return suggest(df)
