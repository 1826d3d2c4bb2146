"""Session helpers: one place for the settings every study relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "panelcast",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time and the UI off.

    ``master`` is only set when given, so that ``spark-submit`` decides on a
    cluster.  Local runs (tests, bench) pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("PANELCAST_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Only a local session (tests, bench) without
    that setting gets a fresh scratch folder of its own; on a cluster a
    missing setting is an error, since a machine-local folder would not
    survive the loss of an executor."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
        d = tempfile.mkdtemp(prefix="panelcast-ckpt-", dir=os.environ.get("PANELCAST_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for tables written to cut
    lineage or to hand results between jobs."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table (its ``_SUCCESS`` marker) exists at ``path``
    on the cluster's file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return bool(p.getFileSystem(conf).exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables (with their ``_SUCCESS`` marker) in a
    folder; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [n for n in names if path_exists(spark, f"{path.rstrip('/')}/{n}")]


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``panelcast`` importable by Python workers: zip the package once
    per application on the driver and ``addPyFile`` it; Spark serves the
    file to every executor (what ``spark-submit --py-files`` does).  A no-op
    when already shipped."""
    import shutil
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = tempfile.mkdtemp(prefix="panelcast-pkg-")
    archive = shutil.make_archive(os.path.join(base, "panelcast"), "zip", os.path.dirname(pkg), "panelcast")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
