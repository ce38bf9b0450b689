"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings the library relies on. They are applied to sessions we build and
# (for the ones that change results) checked or set on sessions we are given.
RESULT_CONF = {
    # Timestamps in the audit log and the DuckDB oracle are compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Strict JSON check: duplicate keys are valid JSON (last one wins).
    "spark.sql.variant.allowDuplicateKeys": "true",
}

PERF_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text rows are large and regex-heavy: keep scan splits moderate so a
    # 100 TB input yields many tasks and each task's batch fits in memory.
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.sql.parquet.enableVectorizedReader": "true",
}


def build_session(master: str | None = None, app: str = "tollgate", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, pass no master and
    let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {**RESULT_CONF, **PERF_CONF, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_result_conf(spark)
    return spark


def apply_result_conf(spark: SparkSession) -> None:
    """Make result-affecting settings hold on a given session."""
    for k, v in RESULT_CONF.items():
        try:
            if spark.conf.get(k, None) != v:
                spark.conf.set(k, v)
        except Exception:  # pragma: no cover - static conf on a remote session
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (a core setting,
    fixed when the application starts), else the folder registered with
    ``SparkContext.setCheckpointDir``. Only under a local master (tests) is
    a fresh temporary folder registered when neither exists; on a cluster
    that is an error, since a temporary folder is not shared."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:
        d = None
    if d:
        return d.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="tollgate-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there; any other read error is raised."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tollgate/{name}-{uuid.uuid4().hex[:12]}"
