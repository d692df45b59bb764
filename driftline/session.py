"""Spark session and shared-folder helpers.

All scratch output (CSV round trips, JSON event sinks, stream checkpoints,
lineage cuts) goes below the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (unit tests,
local runs) do we create one of our own.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark decides broadcast joins on measured sizes only (AQE); this is the
    # cap for any side it may broadcast.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "driftline",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``driftline`` importable in every Python worker (executors on a cluster).

    Python-side operators (the limiter fold, stateful stream processors)
    are pickled by reference to this package, so workers must import it:
    the package is zipped on the driver once per application and handed to
    ``addPyFile``, which distributes it like ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="driftline-pyfiles-"), "driftline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _dirs, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set only where the session has none."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app_id = sc.applicationId
    if app_id not in _LOCAL_FALLBACK and sc.getCheckpointDir():  # set by the caller
        _LOCAL_FALLBACK[app_id] = sc.getCheckpointDir().rstrip("/")
    if app_id not in _LOCAL_FALLBACK and not sc.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder that all machines share")
    if app_id not in _LOCAL_FALLBACK:
        local = tempfile.mkdtemp(prefix="driftline-ckpt-")
        sc.setCheckpointDir(local)
        _LOCAL_FALLBACK[app_id] = local
    return _LOCAL_FALLBACK[app_id]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the checkpoint dir; removed when the driver's Python ends."""
    own = f"{checkpoint_dir(spark)}/driftline/{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application in whatever store it lies, if the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)
