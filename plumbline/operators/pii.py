"""Personal data in any column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import text
from plumbline.operators.cells import (
    repeated_columns, tally, text_cells, weighted_cells)
from plumbline.roles import col

SAMPLES = 5
# A cheap condition every match implies.  It is tested first and shared between types, so
# the costly patterns see only the few cells that can match; results do not change.
_FOUR_DIGITS = r"[0-9]{4}"
_NEEDS = {
    "email": "@", "phone": _FOUR_DIGITS, "aadhaar": _FOUR_DIGITS, "ssn": _FOUR_DIGITS,
    "passport": r"[a-zA-Z][0-9]{6}", "ipv4": r"[0-9]\.[0-9]",
}
# Characters the shortest match has; most numbers are too short for any type.
_SHORTEST = {"email": 6, "phone": 9, "credit_card": 13, "aadhaar": 12, "passport": 7,
             "ipv4": 7, "ssn": 11}


def as_text(df: DataFrame) -> DataFrame:
    """All atomic columns as plain text; doubles without exponents."""
    out = []
    for c in roles.columns(df):
        cell = col(c.name)
        if c.dtype.typeName() in ("double", "float"):
            cell = text.num_text(cell.cast("double"))
        out.append(cell.cast("string").alias(c.name))
    return df.select(out)


def _hit(v, kind: str):
    cond = v.rlike(vocab.PII_PATTERNS[kind])
    if kind == "credit_card":
        return (F.length(v) >= _SHORTEST[kind]) & cond & text.luhn(v)
    need = _NEEDS[kind]
    possible = v.contains(need) if need == "@" else v.rlike(need)
    return (F.length(v) >= _SHORTEST[kind]) & possible & cond


def match_counts(df: DataFrame, repeated: list[str] | None = None) -> DataFrame:
    """column, total, pii_type, type_order, matches for every type with a match."""
    v = F.col("value")
    plain = as_text(df)
    if repeated is None:
        repeated = repeated_columns(df)  # cheaper on the typed columns than on their text
    cells = weighted_cells(plain, plain.columns, repeated).where(v.isNotNull())
    return from_tallies(cells.groupBy("column").agg(F.sum("n").alias("total"), *tallies()))


def tallies() -> list[Column]:
    """A count per type over weighted cells."""
    return [tally(_hit(F.col("value"), k)).alias(k) for k in vocab.PII_PATTERNS]


def from_tallies(counts: DataFrame) -> DataFrame:
    """match_counts of a frame with a column, total (non-null cells) and its tallies per row."""
    rows = F.array(*[F.struct(F.lit(k).alias("pii_type"), F.lit(i).alias("type_order"),
                              F.col(k).alias("matches"))
                     for i, k in enumerate(vocab.PII_PATTERNS)])
    return counts.select("column", "total", F.inline(rows)).where("matches > 0")


def columns(counts: DataFrame) -> DataFrame:
    """One row per column with personal data: the type with the highest share wins."""
    ratio = F.col("matches") / F.col("total")
    best = F.max_by(F.struct("pii_type", "matches", "total"),
                    F.struct(ratio, (-F.col("type_order")).alias("o")))
    picked = counts.groupBy("column").agg(best.alias("b")).select("column", "b.*")
    hints = F.create_map(*[F.lit(x) for kv in vocab.PII_NAME_HINTS.items() for x in kv])
    hint = F.try_element_at(hints, F.replace(
        text.folded(F.col("column")), F.lit(" "), F.lit("_")))
    share = F.col("matches") * 100.0 / F.col("total")
    return picked.select(
        "column", "pii_type",
        F.when(hint == F.col("pii_type"), "high").when(share > 80, "high")
        .when(share > 30, "medium").otherwise("low").alias("confidence"),
        F.col("matches").alias("match_count"), F.col("total").alias("total_rows"),
        F.round(F.col("matches") / F.col("total"), 4).alias("match_ratio"))


def risk(found: DataFrame) -> DataFrame:
    """One row: pii_columns, risk_level."""
    high = F.count_if(F.col("confidence") == "high")
    medium = F.count_if(F.col("confidence") == "medium")
    return found.agg(F.count("*").alias("pii_columns"),
                     F.when(high >= 1, "high").when(medium >= 2, "medium")
                     .when(F.count("*") > 0, "low").otherwise("none").alias("risk_level"))


def samples(df: DataFrame, found: DataFrame, mask: bool = True, k: int = SAMPLES) -> DataFrame:
    """column, rank, sample: up to k distinct matching cells per column, masked by default."""
    v = F.col("value")
    plain = as_text(df)
    kinds = found.select("column", "pii_type")  # one row per column
    hit = None
    for kind in vocab.PII_PATTERNS:
        cond = F.col("pii_type") == kind
        hit = F.when(cond, _hit(v, kind)) if hit is None else hit.when(cond, _hit(v, kind))
    cells = text_cells(plain, plain.columns).join(F.broadcast(kinds), "column").where(hit)
    w = Window.partitionBy("column").orderBy("value")
    shown = F.regexp_replace("value", "[0-9A-Za-z]", "*") if mask else v
    return (cells.distinct().withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("column", F.col("rank").cast("bigint").alias("rank"),
                    shown.alias("sample")))
