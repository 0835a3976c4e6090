"""Version log of many datasets as one append-only event table.

Log columns: dataset_id, version, event ('create', 'restore', 'delete'), row_count,
event_time, and optionally col_count, columns, changes, path.  A delete event is a
tombstone for its version; a restore makes an older version current again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import changes, state
from plumbline.operators.running import with_previous
from plumbline.roles import col

LOG_SCHEMA = ("dataset_id string, version bigint, event string, row_count bigint, "
              "col_count bigint, columns array<string>, changes array<string>, path string, "
              "event_time timestamp")


def live(log: DataFrame) -> DataFrame:
    """dataset_id, version, row_count, created_at: versions that are not deleted."""
    is_delete = F.col("event") == "delete"
    return (log.groupBy("dataset_id", "version").agg(
        F.bool_or(is_delete).alias("gone"),
        F.max_by(F.when(~is_delete, F.col("row_count")), F.when(~is_delete, F.col("event_time")))
        .alias("row_count"),
        F.min(F.when(~is_delete, F.col("event_time"))).alias("created_at"))
        .where(~F.col("gone")).drop("gone"))


def current(log: DataFrame) -> DataFrame:
    """dataset_id, version: the version of the latest create or restore event."""
    alive = log.where("event <> 'delete'").join(
        log.where("event = 'delete'").select("dataset_id", "version").distinct(),
        ["dataset_id", "version"], "left_anti")
    return alive.groupBy("dataset_id").agg(
        F.max_by("version", F.struct("event_time", "version")).alias("version"))


def resolve(log: DataFrame, version: int | None = None) -> DataFrame:
    """dataset_id, version: the given live version, or each dataset's current one."""
    if version is None:
        return current(log)
    return live(log).where(F.col("version") == version).select("dataset_id", "version")


def listing(log: DataFrame) -> DataFrame:
    """Live versions with source, parent_version, is_latest; order with newest_first."""
    cur = current(log).withColumnRenamed("version", "current")
    v = F.col("version")
    if "changes" in log.columns:
        cleaned = (log.where("event = 'create'").select(
            "dataset_id", "version", (F.coalesce(F.size("changes"), F.lit(0)) > 0)
            .alias("cleaned")))
        base = live(log).join(cleaned, ["dataset_id", "version"], "left")
    else:
        base = live(log).withColumn("cleaned", v > 1)
    return base.join(cur, "dataset_id").select(
        "dataset_id", "version", "row_count", "created_at",
        F.when(F.col("cleaned"), "cleaning").otherwise("upload").alias("source"),
        F.when(v > 1, v - 1).alias("parent_version"), (v == F.col("current")).alias("is_latest"))


def metadata(log: DataFrame, version: int | None = None) -> DataFrame:
    """Everything known of the given live version, or of each dataset's current one."""
    made = log.where("event = 'create'").select(
        "dataset_id", "version", "col_count", "columns", "changes", "path")
    return resolve(log, version).join(listing(log), ["dataset_id", "version"]).join(
        made, ["dataset_id", "version"])


def newest_first(versions: DataFrame) -> DataFrame:
    return versions.orderBy("dataset_id", F.desc("version"))


def diff_consecutive(log: DataFrame) -> DataFrame:
    """dataset_id, version_a, version_b, rows_a, rows_b, row_delta for neighbouring live
    versions."""
    pairs = with_previous(live(log), "dataset_id", "version", ["version", "row_count"])
    return pairs.where("prev_version IS NOT NULL").select(
        "dataset_id", F.col("prev_version").alias("version_a"),
        F.col("version").alias("version_b"), F.col("prev_row_count").alias("rows_a"),
        F.col("row_count").alias("rows_b"),
        (F.col("row_count") - F.col("prev_row_count")).alias("row_delta"))


def diff(log: DataFrame, version_a: int, version_b: int) -> DataFrame:
    """One row per dataset that has both versions: row and column deltas, columns added and
    removed, changes made in b."""
    rich = log.where("event = 'create'")

    def side(v, s):
        return rich.where(F.col("version") == v).select(
            "dataset_id", F.col("row_count").alias(f"rows_{s}"),
            F.col("col_count").alias(f"cols_{s}"), F.col("columns").alias(f"c_{s}"),
            F.col("changes").alias(f"ch_{s}"))
    return side(version_a, "a").join(side(version_b, "b"), "dataset_id").select(
        "dataset_id", "rows_a", "rows_b", (F.col("rows_b") - F.col("rows_a")).alias("row_delta"),
        "cols_a", "cols_b", (F.col("cols_b") - F.col("cols_a")).alias("col_delta"),
        F.array_sort(F.array_except("c_b", "c_a")).alias("columns_added"),
        F.array_sort(F.array_except("c_a", "c_b")).alias("columns_removed"),
        F.col("ch_b").alias("changes_in_b"))


def next_version(log: DataFrame) -> DataFrame:
    """dataset_id, version: one above every number ever used, so nothing is overwritten."""
    return log.groupBy("dataset_id").agg((F.max("version") + 1).alias("version"))


def deletable(log: DataFrame) -> DataFrame:
    """dataset_id, version that may be deleted: neither the only nor the current one."""
    n = live(log).groupBy("dataset_id").agg(F.count("*").alias("n"))
    cur = current(log)
    return (live(log).select("dataset_id", "version")
            .join(cur, ["dataset_id", "version"], "left_anti")
            .join(n.where("n > 1").select("dataset_id"), "dataset_id", "left_semi"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, checksum.  Independent of row order and partitioning.

    Two sums of row hashes with different seeds.  A null takes part as a flag of its column,
    as the hash itself passes over nulls.
    """
    cells = [x for c in roles.columns(df) for x in (col(c.name).isNull(), col(c.name))]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")), F.lit(0))
            .cast("string") for seed in (1, 2)]
    return df.agg(F.count("*").alias("rows"), F.concat_ws("/", *sums).alias("checksum"))


def search(datasets: DataFrame, needle: str) -> DataFrame:
    """Datasets whose name contains the text, ignoring case; newest (largest id) first."""
    return datasets.where(F.lower("name").contains(needle.lower())).orderBy(
        F.desc("dataset_id"))


def by_file_type(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy("file_type").agg(F.count("*").alias("datasets"))


class VersionStore:
    """Versions of tables under one root folder: <root>/data/<dataset>/v=N and <root>/log.

    Both are Parquet and append-only.  Writers of the same dataset must be serialised by
    the caller, as with any plain file layout.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")

    def _append(self, dataset, version, event, rows=None, cols=None, changes=None, path=None):
        now = dt.datetime.now(dt.timezone.utc)
        self.spark.createDataFrame(
            [(dataset, version, event, rows, len(cols) if cols else None, cols,
              changes or [], path, now)], LOG_SCHEMA).write.mode("append").parquet(
            f"{self.root}/log")

    def _events(self, dataset: str) -> DataFrame | None:
        try:
            return self.log().where(F.col("dataset_id") == dataset)
        except Exception as e:  # no log folder yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _state_path(self, dataset: str, version: int) -> str:
        return f"{self.root}/state/{dataset}/v={version}"

    def register(self, dataset: str, df: DataFrame, changes: list[str] | None = None,
                 keep_state: bool = True) -> int:
        """Store df as the next version and return its number.  With its state kept (two more
        scans of what was stored), comparisons need not read it again."""
        events = self._events(dataset)
        row = next_version(events).first() if events is not None else None
        version = row["version"] if row else 1
        path = f"{self.root}/data/{dataset}/v={version}"
        names = [c for c in df.columns if c not in roles.ROW_IDENTITY]
        df.select([col(n) for n in names]).write.mode("error").parquet(path)
        stored = self.spark.read.parquet(path)
        rows = stored.count()  # answered from file footers
        if keep_state:
            state.save(state.of(stored), self._state_path(dataset, version))
        self._append(dataset, version, "create", rows, names, changes, path)
        return version

    def current(self, dataset: str) -> int:
        return resolve(self._events(dataset)).first()["version"]

    def read(self, dataset: str, version: int | None = None) -> DataFrame:
        version = version or self.current(dataset)
        row = (live(self._events(dataset)).where(F.col("version") == version).first())
        if row is None:
            raise KeyError(f"{dataset} has no version {version}")
        return self.spark.read.parquet(f"{self.root}/data/{dataset}/v={version}")

    def changes(self, dataset: str, version: int, other: int | DataFrame) -> DataFrame:
        """The change summary from a version to another, or to a table that is not registered.

        Of versions with kept state only the schema is read, and the columns of changed values
        too long to be in the state; of versions without, the table.
        """
        def side(v):
            df = self.read(dataset, v)
            return df, state.load(self.spark, self._state_path(dataset, v)) or state.of(df)
        a, state_a = side(version)
        b, state_b = side(other) if isinstance(other, int) else (other, state.of(other))
        return changes.summary_of(a, b, state_a, state_b)

    def restore(self, dataset: str, version: int) -> None:
        """Make an older version current; no data is copied."""
        row = live(self._events(dataset)).where(F.col("version") == version).first()
        if row is None:
            raise KeyError(f"{dataset} has no version {version}")
        self._append(dataset, version, "restore", row["row_count"])

    def delete(self, dataset: str, version: int) -> None:
        """Hide a version; the only and the current one are refused."""
        if not deletable(self._events(dataset)).where(F.col("version") == version).take(1):
            raise ValueError(f"version {version} of {dataset} cannot be deleted")
        self._append(dataset, version, "delete")
