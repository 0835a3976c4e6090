"""Quality score: penalties -> dimensions -> one score row.

Every rule turns small result frames (one row per column or per table) into penalty rows;
the score is an aggregate over penalties.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.operators import anomalies, facts, pii, profile, security
from plumbline.operators.cells import (
    TABLE, distinct_estimates, in_columns, names_of, often_repeated, pin, together)
from plumbline.operators.running import with_previous

PENALTY = ("dimension", "reason", "impact", "deduction", "affected_columns")


@dataclass(frozen=True)
class ScoreConfig:
    """The same inputs for every score that is to be compared with another."""

    method: str = "all"
    as_of: dt.date | None = None
    with_security: bool = True
    with_pii: bool = True
    values_per_column: int = vocab.ANOMALY_LIST_LIMIT  # anomalous values that cost points


@dataclass(frozen=True)
class Measures:
    """Small frames the rules read; table is the frame they were measured on."""

    table: DataFrame
    size: DataFrame            # rows, columns, null_rows
    missing: DataFrame         # column, rows, missing_count, missing_pct
    duplicates: DataFrame      # rows, exact_dups, logical_dups, ...
    text: DataFrame            # facts.text_view
    ages: DataFrame            # column, age_bad
    variants: DataFrame        # column, raw, canonical
    anomalies: DataFrame       # anomalies.assemble
    threats: DataFrame | None  # security.threat_counts
    pii: DataFrame | None      # pii.columns
    delimiters: DataFrame | None  # delimiters.delimiter_report
    values_per_column: int = vocab.ANOMALY_LIST_LIMIT


def measure(df: DataFrame, config: ScoreConfig = ScoreConfig(),
            delimiters: DataFrame | None = None) -> Measures:
    """Run the measuring jobs.  Their number grows by one per 50 columns (distinct sketches)
    and per 4 numeric columns (exact ranks).  Typed dates are measured as ISO texts.

    Results are bounded by the schema (a row per column, threat or PII type) and pinned, so
    the rules on top never rescan the table.
    """
    df = roles.dates_as_text(df)
    estimates = distinct_estimates(df)
    counted, numbers, dups, variants = together(
        lambda: pin(facts.cell_facts(df, config.as_of, often_repeated(estimates),
                                     config.with_security, config.with_pii)),
        lambda: pin(facts.number_facts(df)),
        lambda: pin(profile.duplicates(df)),
        lambda: pin(facts.case_variants(df, "status")))
    columns = counted.where(F.col("column") != TABLE)
    text = pin(facts.text_view(columns.where(in_columns(names_of(df, "string")))))
    as_dates = facts.date_columns(df, text)
    odd = pin(anomalies.detect(df, config.method, as_dates, numbers, estimates,
                               facts.flagged_columns(df, text, as_dates)))
    found = pin(security.from_tallies(columns)) if config.with_security else None
    personal = pin(pii.columns(pii.from_tallies(columns))) if config.with_pii else None
    size = counted.where(F.col("column") == TABLE).agg(
        F.coalesce(F.max("nulls"), F.lit(0)).alias("null_rows"),
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))
    missing = columns.select("column", "rows", F.col("missing").alias("missing_count"))
    return Measures(
        table=df, size=size.withColumn("columns", F.lit(len(roles.columns(df)))), text=text,
        missing=missing.withColumn(
            "missing_pct", F.round(F.try_divide(
                F.col("missing_count") * 100.0, F.col("rows")), 2)),
        duplicates=dups,
        ages=numbers.select("column", "age_bad").unionByName(text.select("column", "age_bad")),
        variants=variants, anomalies=odd, threats=found, pii=personal, delimiters=delimiters,
        values_per_column=config.values_per_column)


def _row(dimension: str, reason: Column, impact, deduction: Column, columns: Column):
    impact = F.lit(impact) if isinstance(impact, str) else impact
    return [F.lit(dimension).alias("dimension"), reason.alias("reason"),
            impact.alias("impact"), deduction.cast("double").alias("deduction"),
            columns.cast("array<string>").alias("affected_columns")]


def _none() -> Column:
    return F.array().cast("array<string>")


def _power(pct: Column, factor: float, cap: float) -> Column:
    return F.least(F.pow(pct, F.lit(1.2)) * factor, F.lit(cap))


def completeness(m: Measures) -> DataFrame:
    """Missing share of all cells, and rows without any value."""
    pct = F.col("p")
    cells = m.missing.agg(
        F.sum("missing_count").alias("missing"), F.sum("rows").alias("cells"),
        F.array_sort(F.collect_list(F.when(F.col("missing_count") > 0, F.col("column"))))
        .alias("affected")).withColumn("p", F.try_divide(F.col("missing") * 100.0, F.col("cells")))
    missing = cells.where("missing > 0").select(*_row(
        "completeness", F.format_string("%.1f%% of cells are missing", pct),
        F.when(pct >= 20, "high").when(pct >= 5, "medium").otherwise("low"),
        _power(pct, 0.35, 35.0), F.col("affected")))
    n = F.col("null_rows")
    empty = m.size.where("null_rows > 0").select(*_row(
        "completeness", F.format_string("%d empty row(s)", n),
        F.when(n > 5, "high").otherwise("medium"), F.least(n * 2, F.lit(10)), _none()))
    return missing.unionByName(empty)


def validity(m: Measures) -> DataFrame:
    """Impossible ages, malformed emails, bad dates and mixed types."""
    one = F.array("column")
    ages = m.ages.where("age_bad > 0").select(*_row(
        "validity", F.format_string("%d impossible age(s) in '%s'", "age_bad", "column"),
        "high", F.least(F.col("age_bad") * 2, F.lit(15)), one))
    t = m.text.withColumn("known", F.col("rows") - F.col("nulls"))
    pct = F.try_divide(F.col("email_bad") * 100.0, F.col("known"))
    emails = t.where("email_bad > 0").select(*_row(
        "validity", F.format_string("%d invalid email(s) in '%s'", "email_bad", "column"),
        F.when(pct >= 50, "high").otherwise("medium"), F.least(pct * 0.5, F.lit(10.0)), one))
    bad = F.col("date_unparseable") + F.col("date_bad_year") + F.col("date_future")
    date_names = [c.name for c in roles.columns(m.table) if c.has("date")]
    dates = t.where(in_columns(date_names)).withColumn("bad", bad).where("bad > 0").select(*_row(
        "validity", F.format_string("%d invalid date(s) in '%s'", "bad", "column"),
        F.when(F.col("bad") < 5, "medium").otherwise("high"),
        F.least(F.col("bad") * 2, F.lit(10)), one))
    plain = [c.name for c in roles.columns(m.table) if c.kind == "string"
             and not any(c.has(r) for r in ("email", "date", "status", "id"))]
    odd = F.col("known") - F.col("numeric")
    share = F.try_divide(odd * 100.0, F.col("known"))
    mixed = t.where(in_columns(plain) & (F.col("known") >= 5) & (odd >= 2)
                    & (F.col("numeric") >= 0.7 * F.col("known"))).select(*_row(
                        "validity", F.format_string(
                            "Mixed data types in '%s': %d value(s) are no numbers",
                            F.col("column"), odd),
                        "high", _power(share, 0.4, 8.0), one))
    return ages.unionByName(emails).unionByName(dates).unionByName(mixed)


def consistency(m: Measures) -> DataFrame:
    """Mixed delimiters, date notations and letter case."""
    date_names = [c.name for c in roles.columns(m.table) if c.has("date")]
    k = F.size("date_formats")
    formats = m.text.where(in_columns(date_names) & (k >= 2)).select(*_row(
        "consistency", F.concat(F.lit("Mixed date formats in '"), F.col("column"),
                                F.lit("': "), F.array_join("date_formats", ", ")),
        F.when(k > 2, "high").otherwise("medium"), F.lit(6.0), F.array("column")))
    case = m.variants.where("raw > canonical").select(*_row(
        "consistency", F.format_string("Case inconsistency in '%s': %d spellings of %d values",
                                       "column", "raw", "canonical"),
        "low", F.lit(3.0), F.array("column")))
    out = formats.unionByName(case)
    if m.delimiters is not None:
        out = out.unionByName(m.delimiters.where("mixed").select(*_row(
            "consistency", F.concat(F.lit("Mixed delimiters: "), F.col("delimiters_found")),
            "high", F.lit(15.0), _none())))
    return out


def uniqueness(m: Measures) -> DataFrame:
    """Duplicate rows, exact or apart from ids."""
    n = F.greatest("exact_dups", "logical_dups")
    pct = F.try_divide(n * 100.0, F.col("rows"))
    return m.duplicates.withColumn("n", n).withColumn("p", pct).where("n > 0").select(*_row(
        "uniqueness", F.format_string("%d duplicate row(s), %.1f%%", "n", "p"),
        F.when(F.col("p") >= 10, "high").when(F.col("p") >= 2, "medium").otherwise("low"),
        _power(F.col("p"), 0.6, 15.0), _none()))


def threats(m: Measures) -> DataFrame:
    """Injection payloads by type, and personal data."""
    parts = []
    if m.threats is not None:
        parts.append(security.summary(m.threats).select(*_row(
            "security", F.format_string("%s: %d occurrence(s)",
                                        F.initcap(F.replace("threat_type", F.lit("_"), F.lit(" "))),
                                        "occurrences"),
            "high", F.col("occurrences") * vocab.THREAT_OCCURRENCE_POINTS, F.col("columns"))))
    if m.pii is not None:
        names = m.pii.agg(F.array_sort(F.collect_list("column")).alias("names"),
                          F.count_if(F.col("confidence") == "high").alias("h"),
                          F.count_if(F.col("confidence") == "medium").alias("md"))
        n = F.size("names")
        parts.append(names.where(n > 0).select(*_row(
            "security", F.format_string("PII detected in %d column(s)", n),
            F.when((F.col("h") >= 1) | (F.col("md") >= 2), "high").otherwise("low"),
            5 + 3 * n, F.col("names"))))
    if not parts:
        return m.missing.where("false").select(*_row(
            "security", F.lit(""), "low", F.lit(0.0), _none()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def garbage(m: Measures) -> DataFrame:
    """Garbage words and stand-in addresses or dates."""
    cells = m.missing.agg(F.sum("rows")).scalar()
    t = m.text.agg(F.coalesce(F.sum("garbage"), F.lit(0)).alias("g"),
                   F.coalesce(F.sum("placeholders"), F.lit(0)).alias("ph")).withColumn(
                       "p", F.try_divide(F.col("g") * 100.0, cells))
    words = t.where("g > 0").select(*_row(
        "garbage", F.format_string("%d garbage value(s), %.2f%% of cells", "g", "p"),
        F.when(F.col("p") >= 2, "medium").otherwise("low"),
        _power(F.col("p"), 1.5, 12.0), _none()))
    stand_ins = t.where("ph > 0").select(*_row(
        "garbage", F.format_string("%d placeholder value(s)", "ph"), "low",
        F.least(F.col("ph") * 2, F.lit(5)), _none()))
    return words.unionByName(stand_ins)


def anomaly_penalty(m: Measures) -> DataFrame:
    """Anomalous values weighted by severity; so many values count per column."""
    n = F.least("distinct_values", F.lit(m.values_per_column))
    by = m.anomalies.agg(
        *[F.coalesce(F.sum(F.when(F.col("severity") == s, n)), F.lit(0)).alias(s)
          for s in ("high", "medium", "low")],
        F.array_sort(F.collect_list("column")).alias("names"))
    points = F.col("high") * 3 + F.col("medium") * 0.8 + F.col("low") * 0.2
    return by.where(points > 0).select(*_row(
        "anomalies", F.format_string("Anomalous values: %d high, %d medium, %d low",
                                     "high", "medium", "low"),
        F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("low"),
        F.least(points, F.lit(15.0)), F.col("names")))


def base_penalties(m: Measures) -> DataFrame:
    """All penalties except compounding."""
    out = completeness(m)
    for part in (validity, consistency, uniqueness, threats, garbage, anomaly_penalty):
        out = out.unionByName(part(m))
    return out


def dimension_points(base: DataFrame) -> DataFrame:
    """dimension, deducted: points per dimension after its cap; every dimension has a row."""
    sums = {d: F.coalesce(F.sum(F.when(F.col("dimension") == d, F.col("deduction"))), F.lit(0.0))
            for d in vocab.DIMENSIONS}
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), (
        F.least(F.col(d), F.lit(cap)) if cap else F.col(d)).alias("deducted"))
        for d, (cap, _, _) in vocab.DIMENSIONS.items()])
    return base.agg(*[e.alias(d) for d, e in sums.items()]).select(F.inline(rows))


def compounding(points: DataFrame) -> DataFrame:
    """One row: failing (dimensions above 3 points), deduction."""
    failing = F.count_if(F.col("dimension").isin(*vocab.COMPOUNDING_DIMENSIONS)
                         & (F.col("deducted") > 3))
    return points.agg(failing.alias("failing")).withColumn(
        "deduction", F.when(F.col("failing") >= 3, (F.col("failing") - 2) * 5.0).otherwise(0.0))


def penalties(base: DataFrame, points: DataFrame) -> DataFrame:
    """The full list: base penalties rounded to 2 decimals plus compounding."""
    extra = compounding(points).where("deduction > 0").select(*_row(
        "compounding", F.format_string("%d dimensions fail at once", "failing"), "high",
        F.col("deduction"), _none()))
    return base.unionByName(extra).withColumn("deduction", F.round("deduction", 2))


def dimension_scores(points: DataFrame) -> DataFrame:
    """dimension, deducted, score (0-100), weight, weighted for the six weighted dimensions."""
    table = F.create_map(*[x for d, (_, div, w) in vocab.DIMENSIONS.items() if w
                           for x in (F.lit(d), F.struct(F.lit(div).alias("div"),
                                                        F.lit(w).alias("weight")))])
    spec = F.try_element_at(table, F.col("dimension"))
    score = F.greatest(F.round(100 - F.least(F.col("deducted") / F.col("spec.div") * 100,
                                             F.lit(100.0)), 1), F.lit(0.0))
    return (points.withColumn("spec", spec).where("spec IS NOT NULL")
            .withColumn("score", score)
            .select("dimension", F.round("deducted", 2).alias("deducted"), "score",
                    F.col("spec.weight").alias("weight"),
                    F.round(F.col("score") * F.col("spec.weight"), 2).alias("weighted")))


def breakdown(points: DataFrame) -> DataFrame:
    """Legacy view: dimension, score, max; may go negative except for security."""
    table = F.create_map(*[F.lit(x) for kv in vocab.LEGACY_POINTS.items() for x in kv])
    mx = F.try_element_at(table, F.col("dimension"))
    left = F.col("max") - F.col("deducted")
    return (points.withColumn("max", mx).where("max IS NOT NULL").select(
        "dimension", F.round(F.when(F.col("dimension") == "security",
                                    F.greatest(left, F.lit(0.0))).otherwise(left), 2)
        .alias("score"), "max"))


def grade(score: Column) -> Column:
    out = None
    for letter, least in vocab.GRADES:
        out = (F.when(score >= least, letter) if out is None
               else out.when(score >= least, letter))
    return out.otherwise("F")


def verdict(letter: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.VERDICTS.items() for x in kv])
    return F.try_element_at(table, letter)


def final_score(total: Column, failing: Column, has_threats: Column, missing_pct: Column,
                garbage_cells: Column, exact_dups: Column) -> Column:
    """Score after the caps for threats, systemic failure and too little deduction."""
    s = F.greatest(100 - total, F.lit(0.0))
    s = F.when(has_threats, F.least(s, F.lit(30.0))).otherwise(s)
    systemic = ((failing >= 5) | (total >= 75)
                | ((missing_pct > 30) & (garbage_cells > 5) & (exact_dups > 10)))
    s = F.when(systemic, F.least(s, F.lit(38.0))).otherwise(s)
    s = (F.when(total < 5, F.least(s, F.lit(95.0)))
         .when(total < 15, F.least(s, F.lit(88.0))).otherwise(s))
    return F.round(s, 2)


def confidence(rows: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.log10(rows + 1) * 20), 1)


def quality(m: Measures, points: DataFrame) -> DataFrame:
    """One row: score, grade, verdict, confidence and the metadata behind them."""
    comp = compounding(points)
    total = points.agg(F.sum("deducted")).scalar() + comp.select("deduction").scalar()
    miss = m.missing.agg((F.sum("missing_count") * 100.0 / F.sum("rows")).alias("p"))
    threat_n = (m.threats.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
                if m.threats is not None else F.lit(0))
    pii_n = m.pii.agg(F.count("*")).scalar() if m.pii is not None else F.lit(0)
    rows = F.greatest(F.col("rows"), F.lit(1))
    base = m.duplicates.select(
        "rows", "exact_dups", "logical_dups",
        F.round(total, 2).alias("total_deduction"),
        comp.select("failing").scalar().alias("failing_dimensions"),
        F.coalesce(miss.scalar(), F.lit(0.0)).alias("missing_pct"),
        F.coalesce(m.text.agg(F.sum("garbage")).scalar(), F.lit(0)).alias("garbage_cells"),
        threat_n.alias("threats"), pii_n.alias("pii_columns"),
        m.anomalies.agg(F.count("*")).scalar().alias("anomalous_columns"))
    scored = base.withColumn("score", final_score(
        F.col("total_deduction"), F.col("failing_dimensions"), F.col("threats") > 0,
        F.col("missing_pct"), F.col("garbage_cells"), F.col("exact_dups")))
    return scored.select(
        "score", grade(F.col("score")).alias("grade"),
        verdict(grade(F.col("score"))).alias("verdict"),
        confidence(F.col("rows")).alias("confidence"),
        F.round("missing_pct", 2).alias("missing_pct"),
        F.round(F.col("exact_dups") * 100.0 / rows, 2).alias("exact_dup_pct"),
        F.round(F.col("logical_dups") * 100.0 / rows, 2).alias("logical_dup_pct"),
        F.round(F.greatest("exact_dups", "logical_dups") * 100.0 / rows, 2).alias("dup_pct"),
        "anomalous_columns", "pii_columns", "threats", "garbage_cells",
        "failing_dimensions", "total_deduction", "rows")


@dataclass(frozen=True)
class Scored:
    measures: Measures
    penalties: DataFrame
    dimensions: DataFrame
    quality: DataFrame
    points: DataFrame


def score(df: DataFrame, config: ScoreConfig = ScoreConfig(),
          delimiters: DataFrame | None = None) -> Scored:
    """Measure df and derive every score table."""
    return score_measures(measure(df, config, delimiters))


def score_measures(m: Measures) -> Scored:
    base = pin(base_penalties(m))
    points = pin(dimension_points(base))
    return Scored(m, penalties(base, points), dimension_scores(points), quality(m, points),
                  points)


def version_delta(history: DataFrame) -> DataFrame:
    """dataset_id, version, score, delta, status against the previous version."""
    d = F.col("delta")
    return (with_previous(history, "dataset_id", "version", ["score"])
            .withColumn("delta", F.round(F.col("score") - F.col("prev_score"), 2))
            .drop("prev_score")
            .withColumn("status", F.when(d.isNull(), F.lit(None)).when(d <= -20, "unstable")
                        .when(d <= -10, "degraded").when(d >= 5, "improved")
                        .otherwise("stable")))
