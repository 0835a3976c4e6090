"""Session settings the jobs rely on, and checkpoint placement."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
}


_LOCAL_DIR: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; cluster-level ones stay as submitted."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: str = "8", shuffle: str = "8", memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
               .config("spark.sql.shuffle.partitions", shuffle)
               .config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        global _LOCAL_DIR
        _LOCAL_DIR = _LOCAL_DIR or tempfile.mkdtemp(prefix="plumbline-")
        shared = _LOCAL_DIR
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder nobody has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
