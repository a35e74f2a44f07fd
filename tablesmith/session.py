"""Session helpers: building a session for tests/bench and reading cluster settings.

Library functions never create a session; they take DataFrames. These helpers
exist for tests, the bench and the query registry.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables that ``cut_lineage`` has written for the innermost ``TemporaryTables``.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tablesmith") -> SparkSession:
    """Local session used by tests and bench; a cluster passes its own session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def recommended_conf(total_cores: int, shuffle_gb: float = 0.0) -> dict[str, str]:
    """Settings for a large cluster (e.g. 1000 executors reading ~100 TB).

    Shuffle partitions start at ~3 per core (or ~256 MB per partition of the
    expected shuffle volume, whichever is larger) and AQE coalesces them at
    run time; skewed join partitions are split; files are read in 512 MB
    splits; runtime broadcast only below 64 MB of measured size.
    """
    parts = max(3 * total_cores, int(shuffle_gb * 4) if shuffle_gb else 0, 200)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only a local session (tests, bench) without the setting gets a fresh temp folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = current.get() if current.isDefined() else None
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="tablesmith-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


class TemporaryTables:
    """The tables that ``cut_lineage`` writes while ``temporary_tables`` is open."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, paths

    def release(self, keep: DataFrame | None = None) -> int:
        """Remove them, but for those that ``keep`` reads; how many were removed.

        To be called when nothing else will read them: what depends on a removed table fails.
        """
        needed = [f.split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()] if keep is not None else []
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = []
        for path in self.paths:
            bare = path.split(":", 1)[-1].strip("/") if ":" in path.split("/")[0] else path.strip("/")
            if not any(f.startswith(bare + "/") for f in needed):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
                gone.append(path)
        self.paths[:] = [p for p in self.paths if p not in gone]
        return len(gone)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[TemporaryTables]:
    """Collects the tables that ``cut_lineage`` writes inside; ``release`` removes them.  Scopes may nest."""
    paths: list[str] = []
    before = _WRITTEN.set(paths)
    try:
        yield TemporaryTables(spark, paths)
    finally:
        _WRITTEN.reset(before)


def cut_lineage(df: DataFrame, eager: bool = True, how: str = "table") -> DataFrame:
    """Cut lineage into the shared checkpoint folder (survives executor loss).

    ``how="table"`` writes a parquet table there and reads it back (columnar,
    compressed, and much faster than a row checkpoint); ``how="checkpoint"``
    uses Spark's reliable ``checkpoint()``.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    if how == "checkpoint":
        return df.checkpoint(eager=eager)
    path = f"{base}/tablesmith-tables/{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
