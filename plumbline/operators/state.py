"""What comparisons need to know of a version, so that its table need not be read again.

The state of a table is two frames: one row of counts and moments per column, and the hashed
histogram of every column that is no number.  Values shorter than PREFIX characters are in it as
they are; of longer ones it holds the beginning and a 128-bit hash, so it is small beside a table of
long texts and no text is exchanged to make it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.operators.cells import TABLE, pin, text_cells
from plumbline.operators.frequent import KEY, PREFIX, hashed
from plumbline.operators.profile import normalised
from plumbline.roles import col


@dataclass(frozen=True)
class State:
    columns: DataFrame  # column, rows, missing, n, mean, std, min, max; a row __all__ for the table
    values: DataFrame   # column, h1, h2, prefix, n


def column_facts(df: DataFrame) -> DataFrame:
    """column, rows, missing (null words included) and n, mean, std, min, max of numbers, from one
    scan; the row __all__ counts the table's rows, whatever its columns.  None of an empty table."""
    none, parts = F.lit(None).cast("double"), [F.lit(TABLE), F.lit(False), F.lit(None).cast("double")]
    for c in roles.columns(df):
        gap = col(c.name).isNull()
        if c.kind == "string":
            gap = gap | col(c.name).isin(*vocab.NULL_PATTERNS)
        parts += [F.lit(c.name), gap,
                  col(c.name).cast("double") if c.kind == "numeric" else none]
    cells = df.select(F.stack(F.lit(len(parts) // 3), *parts).alias("column", "gap", "x"))
    return cells.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if("gap").alias("missing"), F.count("x").alias("n"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"))


def of(df: DataFrame) -> State:
    """The state of a table; its values are a plan, evaluated where they are used or saved."""
    names = [c.name for c in roles.columns(df) if c.kind != "numeric"]
    values = hashed(text_cells(normalised(df), names), PREFIX).groupBy(*KEY, "prefix").agg(
        F.count("*").alias("n"))
    return State(pin(column_facts(df)), values)


def save(state: State, path: str) -> None:
    state.values.write.mode("error").parquet(f"{path}/values")
    state.columns.coalesce(1).write.mode("error").parquet(f"{path}/columns")


def load(spark: SparkSession, path: str) -> State | None:
    """The saved state, None if there is none; the columns are saved last, so it is whole."""
    try:
        columns = spark.read.parquet(f"{path}/columns")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return State(columns, spark.read.parquet(f"{path}/values"))


def paired_hashes(a: State, b: State, names: list[str]) -> DataFrame:
    """(column, h1, h2, prefix, n_a, n_b) of the values of both versions."""
    none = F.lit(0).cast("bigint")
    both = a.values.select(*KEY, "prefix", F.col("n").alias("n_a"), none.alias("n_b")).unionAll(
        b.values.select(*KEY, "prefix", none, "n")).where(F.col("column").isin(*names))
    return both.groupBy(*KEY, "prefix").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
