"""Tall views of a table: one row per cell, grouped by column.

Grouping cells by column keeps the generated code independent of the table's width, and
every aggregate over it combines map-side, so only (columns x partitions) small rows are
shuffled however many rows the table has.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import roles
from plumbline.roles import col

TABLE = "__all__"


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(),
          "boolean": pa.bool_()}


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Driver-side rows as a local relation (scalar columns only, see _ARROW)."""
    fields = [x.split() for x in ddl.split(",")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table({n: pa.array(list(c), type=_ARROW[t]) for (n, t), c in zip(fields, cols)})
    return spark.createDataFrame(table)


def text_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value STRING) for the named columns; values keep their own spelling."""
    if not names:
        return small_frame(df.sparkSession, [], "column string, value string")
    # stack instead of unpivot: generated code for shared regex results over an unpivot
    # does not compile in Spark 4.1, and the interpreted fallback is several times slower
    pairs = [x for n in names for x in (F.lit(n), col(n).cast("string"))]
    return df.select(F.stack(F.lit(len(names)), *pairs).alias("column", "value"))


def number_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value DOUBLE) for the named numeric columns."""
    if not names:
        return small_frame(df.sparkSession, [], "column string, value double")
    return (df.select([col(n).cast("double").alias(n) for n in names])
            .unpivot([], [col(n) for n in names], "column", "value"))


REPEATED_SHARE = 0.2


def repeated_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    """Columns whose values repeat so much that grouping equal cells first pays off.

    Decided on distinct-count sketches from one cheap scan; it steers the plan only and
    never changes a result.
    """
    return often_repeated(distinct_estimates(df, names))


def distinct_estimates(df: DataFrame, names: list[str] | None = None
                       ) -> dict[str, tuple[int, int, int]]:
    """(rows, non-null rows, sketched distinct values) of every column; a scan per 50."""
    names = names if names is not None else [c.name for c in roles.columns(df)]
    out: dict[str, tuple[int, int, int]] = {}
    for i in range(0, len(names), 50):
        part = names[i:i + 50]
        row = df.agg(F.count("*").alias("rows"), *[x for j, n in enumerate(part) for x in (
            F.count(col(n)).alias(f"n{j}"),
            F.approx_count_distinct(col(n), 0.05).alias(f"d{j}"))]).first()
        out |= {n: (row["rows"], row[f"n{j}"], row[f"d{j}"]) for j, n in enumerate(part)}
    return out


def often_repeated(estimates: dict[str, tuple[int, int, int]]) -> list[str]:
    """Columns whose values repeat so much that grouping equal cells first pays off."""
    return [n for n, (rows, _, d) in estimates.items() if d <= REPEATED_SHARE * rows]


def weighted_cells(df: DataFrame, names: list[str], repeated: list[str] | None = None
                   ) -> DataFrame:
    """(column, value STRING, n): cells with multiplicity.

    Row-local rules depend on a cell's column and value only, so equal cells of repeated
    columns are grouped first (map-side combine; nulls included) and each rule runs once per
    distinct value.  Cells of other columns, such as free text, stay where they are with
    n = 1 and are never shuffled.
    """
    if repeated is None:
        repeated = repeated_columns(df, names) if names else []
    grouped = [n for n in names if n in repeated]
    single = [n for n in names if n not in repeated]
    parts = []
    if grouped:
        parts.append(text_cells(df, grouped).groupBy("column", "value").agg(
            F.count("*").alias("n")))
    if single or not parts:
        parts.append(text_cells(df, single).withColumn("n", F.lit(1).cast("bigint")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def tally(condition: Column) -> Column:
    """Number of weighted cells that meet the condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))


def names_of(df: DataFrame, kind: str, role: str | None = None) -> list[str]:
    return [c.name for c in roles.columns(df)
            if c.kind == kind and (role is None or c.has(role))]


def histogram(cells: DataFrame, by: tuple = ()) -> DataFrame:
    """(column, [by...], value, n) over non-null values.

    Counts combine map-side first, so a value holding a third of all rows costs one row
    per map task in the shuffle.
    """
    return (cells.where(F.col("value").isNotNull())
            .groupBy("column", *by, "value").agg(F.count("*").alias("n")))


def sorted_numbers(by_key: dict[str, list[float]], key: Column) -> Column:
    """The sorted numbers of a key, null for others.

    They are a constant of the plan, so no row carries them; a few dozen keys at a time.
    """
    pairs = [x for k, numbers in by_key.items() for x in (F.lit(k), F.split(F.lit(
        ",".join(map(repr, numbers))), ",").cast("array<double>"))]
    return F.try_element_at(F.create_map(*pairs), key)


def count_below(numbers: Column, v: Column, most: int) -> Column:
    """How many of the sorted numbers, at most `most`, lie below v: a binary search."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(
        F.get(numbers, i + step - 1) < v, i + step).otherwise(i))


def in_columns(names) -> Column:
    """Condition 'this cell belongs to one of the named columns'."""
    names = list(names)
    return F.col("column").isin(*names) if names else F.lit(False)


def pin(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Evaluate a result whose size is bounded by the schema, not the data, exactly once.

    The rows become a local relation, so later steps neither rescan the table nor depend on
    cached blocks that a lost executor would take along.  Exceeding the bound is an error.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ValueError(f"expected at most {max_rows} rows for a small result")
    return df.sparkSession.createDataFrame(table, df.schema)


def together(*actions):
    """Run independent Spark actions at the same time and return their results in order.

    Each action is a job of its own; submitting them together lets the cluster fill the
    tail of one with tasks of the next.
    """
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    share = inheritable_thread_target(session)
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(actions)))) as pool:
        return [f.result() for f in [pool.submit(share(a)) for a in actions]]
