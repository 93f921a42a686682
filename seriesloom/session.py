"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "seriesloom", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    cores = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder; on a cluster such a
    folder would be lost together with its machine.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="seriesloom-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table that a job writes and re-reads."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: With it Spark removes a job's shuffle files when the job ends, and not when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Used where several branches of a plan need the same result.  It cuts the lineage,
    survives the loss of executors, gives every branch the same bits (sums of doubles
    may differ between two runs of a stage) and tells the planner the real size.
    What was shuffled for it leaves the disks as soon as it is written.
    """
    path, conf = scratch_path(df.sparkSession, "table"), df.sparkSession.conf
    before = conf.get(FILE_CLEANUP, None)
    conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FILE_CLEANUP) if before is None else conf.set(FILE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(df: DataFrame) -> int:
    """How many reduce tasks the session plans for; sizes chunk and block counts."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
