"""Readers: CSV, JSON and Parquet into typed frames, with ingest validation.

Text formats are read as strings with reader null tokens removed; column types are then
inferred in ONE distributed aggregate over the whole file (no sampling).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import roles, vocab
from plumbline.functions import text
from plumbline.roles import col

FORMATS = ("csv", "json", "parquet")
_CORRUPT = "_corrupt_record"
_BOOLEAN = ("true", "false", "True", "False", "TRUE", "FALSE")
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_WIDE = "decimal(38,0)"
_RECORD = "_record_text"  # holds records whose number of fields is not the header's


class IngestError(ValueError):
    """The source is of an unknown format or holds no usable record."""


def null_reader_tokens(df: DataFrame) -> DataFrame:
    """Null the CSV reader's missing-value tokens in every string column."""
    return df.select([
        F.when(~col(f.name).isin(*vocab.READER_NA), col(f.name)).alias(f.name)
        if roles.is_string(f.dataType) else col(f.name) for f in df.schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of 'missing': NaN becomes null in floating-point columns."""
    return df.select([
        F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name)
        for f in df.schema.fields])


def inferred_types(df: DataFrame) -> DataFrame:
    """One row per string column: column, non_null, inferred_type.

    A column is bigint / double / boolean only if every non-null cell fits.  Whole numbers
    beyond bigint become decimal(38,0), beyond that they stay text: none is ever rounded.
    """
    names = [f.name for f in df.schema.fields
             if roles.is_string(f.dataType) and f.name != _CORRUPT]
    cells = df.unpivot([], [col(n) for n in names], "column", "value")
    v = F.col("value")
    return (cells.groupBy("column").agg(
        F.count(v).alias("non_null"),
        F.count_if(v.rlike(_INTEGER)).alias("i"),
        F.count_if(v.rlike(_INTEGER) & text.strip(v).try_cast("bigint").isNotNull()).alias("l"),
        F.count_if(v.rlike(_INTEGER) & text.strip(v).try_cast(_WIDE).isNotNull()).alias("w"),
        F.count_if(text.is_num(v)).alias("d"),
        F.count_if(v.isin(*_BOOLEAN)).alias("b"))
        .select("column", "non_null",
                F.when(F.col("non_null") == 0, "string")
                .when(F.col("l") == F.col("non_null"), "bigint")
                .when(F.col("w") == F.col("non_null"), _WIDE)
                .when(F.col("i") == F.col("non_null"), "string")
                .when(F.col("d") == F.col("non_null"), "double")
                .when(F.col("b") == F.col("non_null"), "boolean")
                .otherwise("string").alias("inferred_type")))


def infer(df: DataFrame) -> DataFrame:
    """Cast string columns to the types of inferred_types (one row per column collected)."""
    if not any(roles.is_string(f.dataType) for f in df.schema.fields):
        return df
    kinds = {r["column"]: r["inferred_type"] for r in inferred_types(df).collect()}

    def cast(name):
        kind = kinds.get(name, "string")
        c = col(name)
        if kind in ("bigint", "double", _WIDE):
            return text.strip(c).try_cast(kind).alias(name)
        if kind == "boolean":
            return F.lower(c).try_cast("boolean").alias(name)
        return c

    return df.select([cast(n) for n in df.columns])


def _csv(spark: SparkSession, sep: str, multi_line: bool):
    return (spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
            .option("escape", '"').option("multiLine", multi_line))


def spans_lines(spark: SparkSession, path) -> bool:
    """Whether a record of the CSV file may span lines.

    No quoted field goes on in the next line where all lines have an even number of quotes, so such
    files may be split among tasks.  The lines are read in splits, up to the first that tells.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.where((quotes % 2 == 1) | line.rlike(r"\r[^\r]")).select("value").isEmpty()


def csv_records(spark: SparkSession, path, sep: str = ",",
                multi_line: bool | None = None) -> DataFrame:
    """One row: records, surplus (records with more fields than the header names)."""
    raw, over = _raw_csv(spark, path, sep, multi_line)
    return raw.agg(F.count("*").alias("records"), F.count_if(over).alias("surplus"))


def _raw_csv(spark: SparkSession, path, sep: str, multi_line: bool | None):
    """All columns as text, and the condition that a record has a value beyond the last one.

    The reader keeps the text of every record with another number of fields than the header, too
    few or too many; the fields beyond the header are looked up there, however many there are.
    """
    if multi_line is None:
        multi_line = spans_lines(spark, path)
    names = _csv(spark, sep, multi_line).csv(path).columns
    raw = (_csv(spark, sep, multi_line).option("columnPruning", False)
           .option("columnNameOfCorruptRecord", _RECORD).schema(T.StructType(
               [T.StructField(n, T.StringType()) for n in [*names, _RECORD]])).csv(path))
    mark = re.escape(sep)
    # quoted fields, which may hold separators, count as one letter
    plain = F.regexp_replace(F.rtrim(F.col(_RECORD), F.lit("\r\n")),
                             rf'(^|{mark})"(?:[^"]|"")*"', "$1q")
    beyond = F.slice(F.split(plain, mark), len(names) + 1, 1 << 20)
    # a record is as long as its first field: this also keeps the reader from reading the text alone
    whole = F.length(_RECORD) >= F.length(F.coalesce(col(names[0]), F.lit("")))
    return raw, F.coalesce(whole & F.exists(beyond, lambda x: x != ""), F.lit(False))


def read_csv(spark: SparkSession, path, sep: str = ",", infer_types: bool = True,
             multi_line: bool | None = None) -> DataFrame:
    """CSV with header.  Quoted fields may span lines; a file with such fields is read by one
    task, others are split.  multi_line tells which it is, else the lines are looked through
    first.  Missing fields at the end are null; a record with
    more fields than the header is refused, as its values would be lost."""
    raw, over = _raw_csv(spark, path, sep, multi_line)
    surplus = raw.where(over).count()
    if surplus:
        raise IngestError(f"{surplus} record(s) have more fields than the header")
    df = null_reader_tokens(raw.drop(_RECORD))
    return infer(df) if infer_types else df


def read_json(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """JSON array of flat records, or JSON lines (splittable: use it for large files)."""
    return nan_to_null(spark.read.option("multiLine", not lines).json(path))


def spread(df: DataFrame) -> DataFrame:
    """Give a freshly read frame at least one partition per core.

    Small files have fewer splits than the cluster has cores, which would leave costly
    row-local rules to a few tasks.  A scan with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_parquet(spark: SparkSession, path, row_id: bool = False) -> DataFrame:
    """Parquet; row_id=True adds _row_file and _row_index, a stable position of every row."""
    df = spark.read.parquet(path)
    if row_id:
        df = df.select("*", F.col("_metadata.file_name").alias("_row_file"),
                       F.col("_metadata.row_index").alias("_row_index"))
    return nan_to_null(df)


def read(spark: SparkSession, path, fmt: str, **options) -> DataFrame:
    """Dispatch on format; unknown formats and sources without a record are refused."""
    fmt = fmt.lower().lstrip(".")
    if fmt not in FORMATS:
        raise IngestError(f"unsupported format '{fmt}'; use one of {', '.join(FORMATS)}")
    return validate({"csv": read_csv, "json": read_json, "parquet": read_parquet}[fmt](
        spark, path, **options))


def accepted_formats(files: DataFrame, path: str = "path") -> DataFrame:
    """path, format (the last extension in lower case, '' if none), accepted: what read() would
    make of each file, told from its name alone."""
    fmt = F.lower(F.regexp_extract(F.col(path), r"\.([^./\\]*)$", 1))
    return files.select(F.col(path).alias("path"), fmt.alias("format"),
                        fmt.isin(*FORMATS).alias("accepted"))


def record_quality(df: DataFrame, schema: T.StructType, column: str, fmt: str = "json",
                   ) -> DataFrame:
    """Parse raw records held in a text column; one row: records, corrupt, usable."""
    full = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parse = F.from_json if fmt == "json" else F.from_csv
    target = full if fmt == "json" else full.simpleString()[7:-1].replace(":", " ")
    parsed = df.select(parse(F.col(column), target, opts).alias("r"))
    corrupt = F.col(f"r.{_CORRUPT}").isNotNull()
    return parsed.agg(F.count("*").alias("records"), F.count_if(corrupt).alias("corrupt"),
                      F.count_if(~corrupt).alias("usable"))


def validate(df: DataFrame) -> DataFrame:
    """Refuse a frame without columns or rows; returns df unchanged."""
    if not df.columns:
        raise IngestError("no columns could be read")
    if df.isEmpty():
        raise IngestError("no records could be read")
    return df


def sample_exact(df: DataFrame, n: int = vocab.PROFILE_SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Deterministic sample of n rows: the n smallest salted row hashes.

    A hash cut-off lets only slightly more than n rows through the scan, so the final top-n
    never sees the whole table.  Row contents break ties: the result does not depend on
    partitioning.
    """
    names, rows = [col(n) for n in df.columns], df.count()
    h = F.xxhash64(F.lit(seed), *names)
    share = 1.2 * n / max(rows, 1) + 1e-6
    kept = df
    while share < 1.0:
        cut = int(-(2 ** 63) + share * 2 ** 64)
        kept = df.where(h <= F.lit(cut).cast("bigint"))
        if kept.count() >= n:
            break
        share, kept = 4 * share, df
    return kept.orderBy(h, *names).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Approximate-size sample decided row by row from the row hash: no shuffle at all."""
    buckets = 1_000_000
    keep = F.pmod(F.xxhash64(F.lit(seed), *[col(n) for n in df.columns]), F.lit(buckets)) < int(fraction * buckets)
    return df.where(keep)
