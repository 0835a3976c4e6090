"""Root causes: penalties merged by cause, causes per column, ordered fix steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import text
from plumbline.operators import frequent, profile
from plumbline.operators.cells import (
    TABLE, in_columns, names_of, pin, text_cells, together)
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.score import Measures, grade

CAUSE = ("column", "issue_group", "detection", "severity", "confidence", "explanation")


def _severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def _severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


# ------------------------------------------------------------------ penalties
def issue_group(dimension: Column, reason: Column) -> Column:
    """Group of a penalty: the first rule whose dimension and keyword fit."""
    low, out = F.lower(reason), None
    for dim, word, group in vocab.PENALTY_GROUP_RULES:
        cond = (dimension == dim) & (low.contains(word) if word else F.lit(True))
        out = F.when(cond, group) if out is None else out.when(cond, group)
    return out.otherwise(vocab.DEFAULT_GROUP)


def deduplicate(penalties: DataFrame, keys: tuple = ()) -> DataFrame:
    """One row per (keys..., column set, group): capped deduction, saved points, worst impact.

    keys (such as a dataset id) allow many score reports at once.
    """
    caps = F.create_map(*[F.lit(x) for kv in vocab.GROUP_CAPS.items() for x in kv])
    merged = (penalties
              .withColumn("issue_group", issue_group(F.col("dimension"), F.col("reason")))
              .withColumn("columns", F.array_sort(F.array_distinct("affected_columns")))
              .groupBy(*keys, "columns", "issue_group").agg(
                  F.sum(F.abs("deduction")).alias("raw"), F.count("*").alias("merged"),
                  F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"),
                  F.max(_severity_rank(F.col("impact"))).alias("rank")))
    final = F.least(F.col("raw"), F.try_element_at(caps, F.col("issue_group")))
    return merged.select(
        *keys, "issue_group", F.col("columns").alias("affected_columns"), "reason",
        _severity_name(F.col("rank")).alias("impact"), F.round(final, 2).alias("deduction"),
        F.round("raw", 2).alias("raw_deduction"), F.round(F.col("raw") - final, 2).alias("saved"),
        "merged")


def fair_score(dedup: DataFrame, keys: tuple = ()) -> DataFrame:
    """keys..., fair_score, fair_grade from the merged penalties."""
    s = F.round(F.greatest(100 - F.coalesce(F.sum("deduction"), F.lit(0.0)), F.lit(0.0)), 2)
    return (dedup.groupBy(*keys) if keys else dedup.groupBy()).agg(
        s.alias("fair_score")).withColumn("fair_grade", grade(F.col("fair_score")))


def group_impacts(dedup: DataFrame) -> DataFrame:
    """issue_group, impact, penalties, points, saved, columns: what each group that occurs does
    to the score, and where."""
    sums = dedup.groupBy("issue_group").agg(
        _severity_name(F.max(_severity_rank(F.col("impact")))).alias("impact"),
        F.sum("merged").alias("penalties"), F.round(F.sum("deduction"), 2).alias("points"),
        F.round(F.sum("saved"), 2).alias("saved"))
    places = dedup.select("issue_group", F.explode("affected_columns").alias("column")).groupBy(
        "issue_group").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    return sums.join(places, "issue_group", "left").withColumn(
        "columns", F.coalesce("columns", F.array().cast("array<string>")))


# ------------------------------------------------------------------ causes per column
def _cause(group: str, detection, severity, confidence: Column, explanation: Column) -> list:
    def lit(x):
        return F.lit(x) if isinstance(x, str) else x
    return [F.col("column"), F.lit(group).alias("issue_group"), lit(detection).alias("detection"),
            lit(severity).alias("severity"), F.round(confidence, 4).alias("confidence"),
            explanation.alias("explanation")]


def date_causes(facts: DataFrame) -> DataFrame:
    """Mixed notations, unparseable values, odd but parseable notations."""
    k = F.size("cause_formats")
    mixed = facts.where(k >= 2).select(*_cause(
        "DATE_QUALITY", "mixed_date_formats", F.when(k > 2, "high").otherwise("medium"),
        F.least(F.lit(0.95), 0.5 + k * 0.1),
        F.concat(k.cast("string"), F.lit(" formats: "), F.array_join("cause_formats", ", "))))
    bad = facts.where("date_unparseable > 0").select(*_cause(
        "DATE_QUALITY", "unparseable_dates", "high", F.lit(0.99),
        F.format_string("%d value(s) are no dates", "date_unparseable")))
    odd = facts.where("date_unlabelled > 0").select(*_cause(
        "DATE_QUALITY", "semantic_date_errors", "medium", F.lit(0.8),
        F.format_string("%d value(s) in unusual notation", "date_unlabelled")))
    return mixed.unionByName(bad).unionByName(odd)


def email_causes(facts: DataFrame) -> DataFrame:
    share = F.col("email_bad") / (F.col("rows") - F.col("nulls"))
    return facts.where("email_bad > 0").select(*_cause(
        "EMAIL_QUALITY", "invalid_email", F.when(share >= 0.5, "high").otherwise("medium"),
        F.least(F.lit(0.99), 0.6 + share * 0.4),
        F.format_string("%d invalid address(es)", "email_bad")))


def casing_causes(df: DataFrame) -> DataFrame:
    """Person-name columns whose values differ in letter case only."""
    cells = text_cells(df, names_of(df, "string", "person"))
    distinct = (cells.where(F.col("value").isNotNull())
                .select("column", text.strip(F.col("value")).alias("value")).distinct())
    folded = distinct.groupBy("column", F.lower("value").alias("f")).agg(F.count("*").alias("n"))
    n = folded.groupBy("column").agg(F.sum("n").alias("raw"), F.count("*").alias("canonical"))
    variants = F.col("raw") - F.col("canonical")
    return n.where("raw > canonical").select(*_cause(
        "FORMAT_CONSISTENCY", "inconsistent_casing", "low",
        F.least(F.lit(0.9), 0.55 + variants / F.col("raw")),
        F.format_string("%d spellings of %d values", "raw", "canonical")))


def country_variants(df: DataFrame) -> DataFrame:
    """column, canonical, variants (sorted): countries spelled in more than one way.

    Only known spellings survive the filter, so the grouping handles a few rows per column.
    """
    table = {s: c for c, spellings in vocab.COUNTRY_GROUPS.items() for s in spellings}
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    cells = text_cells(df, names_of(df, "string", "cause_country")).select(
        "column", text.folded(F.col("value")).alias("value"))
    hits = cells.where(F.col("value").isin(*table)).distinct().withColumn(
        "canonical", F.try_element_at(lookup, F.col("value")))
    return (hits.groupBy("column", "canonical").agg(
        F.array_sort(F.collect_list("value")).alias("variants")).where(F.size("variants") > 1))


def country_causes(df: DataFrame) -> DataFrame:
    return country_variants(df).groupBy("column").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("canonical", F.lit(": "), F.array_join("variants", "/")))), "; ")
        .alias("text")).select(*_cause(
            "FORMAT_CONSISTENCY", "category_synonyms", "low", F.lit(0.9), F.col("text")))


def garbage_causes(facts: DataFrame) -> DataFrame:
    share = F.col("sentinel") / (F.col("rows") - F.col("nulls"))
    return facts.where("sentinel > 0").select(*_cause(
        "GARBAGE_VALUES", "garbage_values", F.when(share > 0.1, "medium").otherwise("low"),
        F.least(F.lit(0.99), 0.7 + share * 0.3),
        F.format_string("%d placeholder value(s)", "sentinel")))


def anomaly_causes(found: DataFrame) -> DataFrame:
    return found.select(*_cause(
        "ANOMALY", "statistical_anomaly", F.col("severity"),
        F.when(F.col("severity") == "high", 0.85).otherwise(0.7),
        F.concat(F.col("distinct_values").cast("string"), F.lit(" value(s) by "),
                 F.array_join("methods_used", ", "))))


def pii_causes(found: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in vocab.PII_CONFIDENCE.items() for x in kv])
    conf = F.try_element_at(table, F.col("confidence"))
    return found.select(*_cause(
        "PII_RISK", F.concat(F.lit("pii_"), F.col("pii_type")),
        F.when(conf >= 0.8, "high").otherwise("medium"), conf,
        F.concat(F.lit("contains "), F.col("pii_type"))))


def causes(m: Measures) -> DataFrame:
    """column, issue_group, detection, severity, confidence, explanation for every column."""
    names, countries = together(lambda: pin(casing_causes(m.table)),
                                lambda: pin(country_causes(m.table)))
    out = (date_causes(m.text).unionByName(email_causes(m.text)).unionByName(names)
           .unionByName(countries).unionByName(garbage_causes(m.text))
           .unionByName(anomaly_causes(m.anomalies)))
    return out.unionByName(pii_causes(m.pii)) if m.pii is not None else out


def column_status(found: DataFrame) -> DataFrame:
    """column, status, causes: the worst severity over a column's causes."""
    return found.groupBy("column").agg(
        F.upper(_severity_name(F.max(_severity_rank(F.col("severity"))))).alias("status"),
        F.count("*").alias("causes"))


# ------------------------------------------------------------------ fix steps
# group -> (action, priority rule, Spark snippet); '{c}' stands for the column.
# Action names are fixed values; the hints are this library's own.
_ACTIONS = {
    "DATE_QUALITY": (
        ("parse_dates", "high_else_medium",
         "df.withColumn('{c}', F.try_to_timestamp('{c}'))"),
        ("standardize_date_format", "medium",
         "df.withColumn('{c}', F.date_format('{c}', 'yyyy-MM-dd'))"),
        ("drop_unparseable_dates", "low", "df.dropna(subset=['{c}'])")),
    "EMAIL_QUALITY": (
        ("validate_drop_invalid_emails", "high_else_medium",
         "df.where(email_strict(F.col('{c}')))"),
        ("normalize_email_casing", "low", "df.withColumn('{c}', F.lower(F.trim('{c}')))")),
    "DUPLICATES": (("drop_exact_duplicates", "high", "df.dropDuplicates()"),),
    "GARBAGE_VALUES": (
        ("replace_garbage_with_nan", "medium_else_low",
         "df.withColumn('{c}', junk_normalise(F.col('{c}')))"),),
}
_FORMAT_ACTIONS = (
    ("person", "normalize_name_casing", "medium", "df.withColumn('{c}', title(F.col('{c}')))"),
    ("cause_country", "normalize_country_synonyms", "low",
     "df.withColumn('{c}', canonical(F.col('{c}'), COUNTRY_MAP_CLEANING))"),
    (None, "normalize_casing", "low", "df.withColumn('{c}', F.lower(F.trim('{c}')))"),
)


def _priority(rule: str) -> Column:
    s = F.col("severity")
    if rule == "high_else_medium":
        return F.when(s == "high", "high").otherwise("medium")
    if rule == "medium_else_low":
        return F.when(s == "medium", "medium").otherwise("low")
    return F.lit(rule)


def _step(action: str, priority: Column, hint: str) -> Column:
    return F.struct(F.lit(action).alias("action"), priority.alias("priority"),
                    F.replace(F.lit(hint), F.lit("{c}"), F.col("column")).alias("hint"))


def cause_steps(df: DataFrame, found: DataFrame) -> DataFrame:
    """column, action, priority, hint derived from causes (one row per column and group)."""
    per_group = found.groupBy("column", "issue_group").agg(
        _severity_name(F.max(_severity_rank(F.col("severity")))).alias("severity"))
    steps = F.array().cast("array<struct<action:string,priority:string,hint:string>>")
    group = F.col("issue_group")
    chosen = None
    for g, actions in _ACTIONS.items():
        arr = F.array(*[_step(a, _priority(r), h) for a, r, h in actions])
        chosen = F.when(group == g, arr) if chosen is None else chosen.when(group == g, arr)
    for role, action, priority, hint in _FORMAT_ACTIONS:
        names = [c.name for c in roles.columns(df) if role is None or c.has(role)]
        chosen = chosen.when((group == "FORMAT_CONSISTENCY") & in_columns(names),
                             F.array(_step(action, F.lit(priority), hint)))
    return per_group.select(
        F.when(group == "DUPLICATES", F.lit(TABLE)).otherwise(F.col("column")).alias("column"),
        F.inline(chosen.otherwise(steps))).dropDuplicates(["column", "action"])


def fill_values(df: DataFrame, missing: DataFrame) -> DataFrame:
    """column, strategy, fill_value (text), missing_count for columns with missing cells.

    Numbers: median if strongly skewed, else mean.  Other columns: most frequent value.
    """
    kinds = {c.name: c.kind for c in roles.columns(df)}
    gaps = {r["column"]: r["missing_count"] for r in missing.where("missing_count > 0").collect()}
    numeric = [n for n in gaps if kinds.get(n) == "numeric"]
    other = [n for n in gaps if kinds.get(n) != "numeric"]
    moments, modes = together(
        lambda: pin(profile.numeric_stats(df, numeric)),
        lambda: pin(frequent.modes(df, other)))
    counts = {r["column"]: r["n"] for r in moments.collect()}
    mid = exact_quantiles(df, numeric, (0.5,), counts=counts)
    skewed = F.abs(F.coalesce("skewness", F.lit(0.0))) > vocab.SKEW_FOR_MEDIAN
    numbers = moments.join(mid.drop("n"), "column").select(
        "column", F.when(skewed, "median").otherwise("mean").alias("strategy"),
        F.round(F.when(skewed, F.col("q_50")).otherwise(F.col("mean")), 4).cast("string")
        .alias("fill_value"))
    words = modes.select("column", F.lit("mode").alias("strategy"),
                         F.col("mode").alias("fill_value"))
    return numbers.unionByName(words).join(
        missing.select("column", "missing_count").where("missing_count > 0"), "column")


def fix_steps(df: DataFrame, found: DataFrame, missing: DataFrame) -> DataFrame:
    """position, column, action, priority, hint: de-duplicated, high priority first."""
    fills = fill_values(df, missing)
    quoted = F.when(F.col("strategy") == "mode",
                    F.concat(F.lit("'"), F.col("fill_value"), F.lit("'"))
                    ).otherwise(F.col("fill_value"))
    fill_steps = fills.select(
        "column", F.concat(F.lit("fill_"), F.col("strategy")).alias("action"),
        F.when(F.col("strategy") == "mode", "low").otherwise("medium").alias("priority"),
        F.concat(F.lit("df.fillna({'"), F.col("column"), F.lit("': "), quoted, F.lit("})"))
        .alias("hint"))
    steps = cause_steps(df, found).unionByName(fill_steps).dropDuplicates(["column", "action"])
    w = Window.orderBy(_severity_rank(F.col("priority")).desc(), "column", "action")
    return steps.select(F.row_number().over(w).cast("bigint").alias("position"), "column",
                        "action", "priority", "hint")  # at most a few rows per column
