"""Session construction and shared-storage settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every revlens job expects. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is under the threshold, sort-merge
# otherwise) and splits skewed join partitions; ANSI stays on (Spark 4 default).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "revlens", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with revlens defaults.

    On a cluster, leave ``master`` as None and set ``shuffle_partitions`` to
    the data (about 128-256 MB of shuffle per partition); unset, the
    session's own setting holds.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used. Only a local-mode session without the setting (tests, laptops) gets
    a fresh private folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared (HDFS/S3/...) folder for checkpoints")
    path = tempfile.mkdtemp(prefix="revlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and return it re-read.

    One write job (``Dataset.checkpoint`` would compute the plan twice unless
    cached), the result survives executor loss, and the re-read table carries
    file statistics for adaptive planning. Never a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, for files that
    :func:`clear_materialized` removes."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_MATERIALIZED_PREFIX}{uuid.uuid4().hex}"


def discard(*frames) -> None:
    """Delete tables that ``cut_lineage`` made and no later plan reads."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_MATERIALIZED_PREFIX = "revlens-"


def clear_materialized(spark: SparkSession) -> int:
    """Delete the intermediate tables ``cut_lineage`` wrote to the checkpoint
    folder. Call it at the end of a batch, once no DataFrame built earlier in
    the session will run again. Returns the number of folders removed."""
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        return 0
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = 0
    if fs.exists(path):
        for st in fs.listStatus(path):
            if st.getPath().getName().startswith(_MATERIALIZED_PREFIX):
                fs.delete(st.getPath(), True)
                removed += 1
    return removed
