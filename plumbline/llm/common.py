"""What the corpus operators share: reading tables, cutting lineage, registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is what lies between ASCII white space; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Whole texts pass through Python in batches of so many rows, so that a batch of long texts fits.
BATCH_ROWS = "1000"


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) -> DataFrame under name."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor
    costs nothing that was written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def utf8(c: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def fold(c: str, n: int) -> Column:
    """crc32 of the value as text, modulo n: the fold a row is in."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % n


#: Rows of up to 40 bytes that may be broadcast: 40 MB at most.
SMALL = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """df, which is stored, to be broadcast where a count proves it small, else shuffled."""
    return F.broadcast(df) if df.count() <= SMALL else df
