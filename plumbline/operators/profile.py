"""Table and column profile: counts, missing cells, moments, quantiles, top values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import stats, text
from plumbline.operators.cells import (
    histogram, in_columns, names_of, number_cells, pin, small_frame, text_cells)
from plumbline.operators.frequent import frequent_values
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans.session import checkpointed
from plumbline.roles import col

TOP_VALUES = 10
SAMPLE_VALUES = 5


def normalised(df: DataFrame) -> DataFrame:
    """String columns with null words nulled; everything else untouched."""
    strings = {c.name for c in roles.columns(df) if c.kind == "string"}
    return df.select([text.null_normalise(col(n)).alias(n) if n in strings else col(n)
                      for n in df.columns])


def missing(df: DataFrame) -> DataFrame:
    """column, rows, missing_count, missing_pct after null-word normalisation.

    Only a flag per cell is laid out tall, so numbers are never turned into text.
    """
    pairs = []
    for c in roles.columns(df):
        gap = col(c.name).isNull()
        if c.kind == "string":
            gap = gap | col(c.name).isin(*vocab.NULL_PATTERNS)
        pairs += [F.lit(c.name), gap]
    flags = df.select(F.stack(F.lit(len(pairs) // 2), *pairs).alias("column", "gap"))
    return (flags.groupBy("column")
            .agg(F.count("*").alias("rows"), F.count_if("gap").alias("missing_count"))
            .withColumn("missing_pct", F.round(F.col("missing_count") * 100.0 / F.col("rows"), 2)))


def missing_share(df: DataFrame) -> DataFrame:
    """One row: missing_cells, total_cells, missing_pct of the whole table."""
    return missing(df).agg(
        F.sum("missing_count").alias("missing_cells"), F.sum("rows").alias("total_cells")
    ).withColumn("missing_pct", F.col("missing_cells") * 100.0 / F.col("total_cells"))


def null_rows(df: DataFrame) -> DataFrame:
    """One row: null_rows, rows.  Raw cells; null words do not count here."""
    names = [c.name for c in roles.columns(df)]
    empty = F.coalesce(*[col(n).cast("string") for n in names]).isNull()
    return df.agg(F.count_if(empty).alias("null_rows"), F.count("*").alias("rows"))


def _id_columns(df: DataFrame) -> list[str]:
    return [c.name for c in roles.columns(df) if c.has("id")]


def _row_hash(names: list[str]) -> list:
    """Two hashes of the named cells; a null counts as a flag of its place."""
    cells = [x for n in names for x in (col(n).isNull(), col(n))]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"_h{seed}") for seed in (1, 2)]


def duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, exact_dups, logical_dups and their percentages.

    Logical duplicates ignore id columns.  Rows are counted by two hashes of the columns that
    matter; only rows whose hashes occur more than once are then grouped on the columns
    themselves, so other rows are never shuffled in full and no hash decides alone.
    """
    names = [c.name for c in roles.columns(df)]
    ids = _id_columns(df)
    rest = [n for n in names if n not in ids]
    key = ["_h1", "_h2"]
    hashed = df.select(*map(col, names), *_row_hash(rest or names))
    counts = hashed.groupBy(*key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    suspects = hashed.join(counts.where("_n > 1").select(*key), key, "left_semi")
    distinct = suspects.groupBy(*map(col, names)).agg(F.count("*").alias("_n"))
    if ids and rest:
        groups = distinct.groupBy(*map(col, rest)).agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"))
    else:
        groups = distinct.withColumn("_d", F.lit(1))
    agg = groups.agg(
        F.coalesce(F.sum(F.col("_n") - F.col("_d")), F.lit(0)).alias("exact_dups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("logical_dups")).withColumn(
            "rows", total)
    if ids and not rest:
        agg = agg.withColumn("logical_dups", F.col("exact_dups"))

    def pct(c):
        return F.when(F.col("rows") > 0, F.round(F.col(c) * 100.0 / F.col("rows"), 2)
                      ).otherwise(0.0)
    return agg.select("rows", "exact_dups", pct("exact_dups").alias("exact_dup_pct"),
                      "logical_dups", pct("logical_dups").alias("logical_dup_pct"),
                      F.array(*map(F.lit, ids)).cast("array<string>").alias("id_columns"))


SUSPECTS = 1_000_000       # pairs of row hashes that may be broadcast


def without_duplicates(df: DataFrame) -> tuple[DataFrame, int]:
    """df with one of each group of equal rows, and the number of rows that went.

    Pairs of row hashes that occur more than once are the suspects.  Only rows with such hashes
    are compared, and exchanged, in full; the others stay where they are as long as the suspects
    are few enough to be sent to them.  Of equal rows the one with the least row identity stays.
    """
    names = [c.name for c in roles.columns(df)]
    extra = [n for n in df.columns if n not in names]
    key = ["_h1", "_h2"]
    hashed = df.select(*map(col, df.columns), *_row_hash(names))
    suspects = checkpointed(hashed.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"))
    number, rows = suspects.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if not number:
        return df, 0
    keys = suspects.select(*key)
    keys = F.broadcast(keys) if number <= SUSPECTS else keys
    first = F.min(F.struct(*map(col, extra)) if extra else F.lit(0)).alias("_first")
    kept = hashed.join(keys, key, "left_semi").groupBy(*map(col, names)).agg(first).select(
        *[F.col("_first")[n].alias(n) if n in extra else col(n) for n in df.columns])
    alone = hashed.join(keys, key, "left_anti").select(*map(col, df.columns))
    return alone.unionByName(kept), rows - kept.count()


def value_histogram(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, value STRING, n) over the normalised table."""
    names = names or [c.name for c in roles.columns(df)]
    return histogram(text_cells(normalised(df), names))


def distinct_counts(hist: DataFrame) -> DataFrame:
    """column, unique_count (exact, nulls excluded) of the columns in a histogram."""
    return hist.groupBy("column").agg(F.count("*").alias("unique_count"))


def unique_counts(df: DataFrame) -> DataFrame:
    """column, unique_count (exact, nulls excluded) for every column of df.

    Whole numbers and floats are grouped in their own type, the rest as text.
    """
    groups: dict[str, list[str]] = {}
    for c in roles.columns(df):
        whole = c.dtype.typeName() in ("byte", "short", "integer", "long")
        real = c.dtype.typeName() in ("float", "double")
        groups.setdefault("bigint" if whole else "double" if real else "string", []).append(
            c.name)
    out = None
    for kind, names in groups.items():
        source = normalised(df.select([col(n) for n in names])) if kind == "string" else df
        cells = source.select([col(n).cast(kind).alias(n) for n in names]).unpivot(
            [], [col(n) for n in names], "column", "value")
        part = distinct_counts(histogram(cells))
        out = part if out is None else out.unionByName(part)
    return out


def approx_distinct_counts(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """column, unique_count from mergeable sketches; one scan per 50 columns (each reading
    only its own), no value shuffle."""
    names = [c.name for c in roles.columns(df)]
    clean, out = normalised(df), None
    for i in range(0, len(names), 50):
        part = names[i:i + 50]
        wide = clean.agg(*[F.approx_count_distinct(col(n), rsd).alias(n) for n in part])
        tall = wide.unpivot([], [col(n) for n in part], "column", "unique_count")
        out = tall if out is None else out.unionByName(tall)
    return out


def numeric_stats(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """column, n, min, max, mean, std, skewness, kurtosis for numeric columns, one scan."""
    names = names if names is not None else names_of(df, "numeric")
    v = F.col("value")
    moments = number_cells(df, names).groupBy("column").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("s"), F.kurtosis(v).alias("k"))
    return moments.select(
        "column", "n", "min", "max", "mean", "std",
        stats.skew_g1(F.col("n"), F.col("s")).alias("skewness"),
        stats.kurt_g2(F.col("n"), F.col("k")).alias("kurtosis"))


def extremes(df: DataFrame) -> DataFrame:
    """column, min_value, max_value (texts) of numbers, dates and booleans, compared in the
    column's own type, so no digit of a large number is lost.  One scan."""
    names = [c.name for c in roles.columns(df) if c.kind != "string"]
    if not names:
        return small_frame(df.sparkSession, [],
                           "column string, min_value string, max_value string")
    both = df.agg(*[f(col(n)).cast("string").alias(f"{k}{i}") for i, n in enumerate(names)
                    for k, f in (("a", F.min), ("z", F.max))])
    return both.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("column"), F.col(f"a{i}").alias("min_value"),
        F.col(f"z{i}").alias("max_value")) for i, n in enumerate(names)])))


def sample_values(df: DataFrame, order: list[str], k: int = SAMPLE_VALUES) -> DataFrame:
    """column, rank, value: the first k non-null cells in the given row order."""
    names = [c.name for c in roles.columns(df) if c.name not in order]
    keys = [col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    cells = (normalised(df).select(*keys, *[col(n).cast("string").alias(n) for n in names])
             .unpivot([f"_o{i}" for i in range(len(order))], [col(n) for n in names], "column",
                     "value")
             .where(F.col("value").isNotNull()))
    w = Window.partitionBy("column").orderBy(*[f"_o{i}" for i in range(len(order))])
    return (cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", F.col("rank").cast("bigint").alias("rank"), "value"))


def categorical_flags(df: DataFrame, hist: DataFrame) -> DataFrame:
    """column, unique_count, is_potentially_categorical for string columns."""
    strings = names_of(df, "string")
    return (missing(df.select([col(n) for n in strings])).join(distinct_counts(hist), "column", "left")
            .select("column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
                    (F.coalesce("unique_count", F.lit(0))
                     < F.greatest(F.lit(10.0), F.col("rows") * 0.05))
                    .alias("is_potentially_categorical")))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column with everything above.

    The joined frames all have one row per column, so these joins are of trivial size
    whatever the table holds.  exact=False takes distinct counts from sketches and skips
    top values, which avoids shuffling values altogether.
    """
    numeric = names_of(df, "numeric")
    dtypes = F.create_map(*[F.lit(x) for c in roles.columns(df)
                            for x in (c.name, c.dtype.simpleString())])
    out = missing(df).withColumn("dtype", F.try_element_at(dtypes, F.col("column")))
    words = [c.name for c in roles.columns(df) if c.kind != "numeric"]
    if exact:
        out = out.join(unique_counts(df), "column", "left")
        if words:
            top = frequent_values(normalised(df), words, TOP_VALUES).groupBy("column").agg(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
            out = out.join(top, "column", "left")
    else:
        out = out.join(approx_distinct_counts(df), "column", "left")
    moments = pin(numeric_stats(df, numeric))
    counts = {r["column"]: r["n"] for r in moments.collect()}
    quantiles = exact_quantiles(df, numeric, counts=counts).select(
        "column", F.col("q_25").alias("q1"), F.col("q_50").alias("median"),
        F.col("q_75").alias("q3"))
    return (out.withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
            .withColumn("is_potentially_categorical", F.when(
                ~in_columns(numeric), F.col("unique_count")
                < F.greatest(F.lit(10.0), F.col("rows") * 0.05)))
            .join(moments.drop("n"), "column", "left")
            .join(quantiles, "column", "left")
            .join(extremes(df), "column", "left"))
