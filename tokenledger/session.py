"""SparkSession helpers.

The settings here are defaults for local runs and tests. On a cluster the
session already exists (``getOrCreate`` returns it) and the cluster's own
configuration wins; we only fill what is unset.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python workers talk to the JVM over a socket file, not a TCP port.
    "spark.python.unix.domain.socket.enabled": "true",
    # State store: Spark's default (in-memory, checkpointed) provider locally.
    # The keyed state here is one small record per key. On a cluster with very
    # many keys set the RocksDB provider there, with changelog checkpointing
    # (``...stateStore.rocksdb.changelogCheckpointing.enabled``); enabling it
    # below only takes effect when RocksDB is chosen.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_spark(app: str = "tokenledger", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    conf = dict(_LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("TOKENLEDGER_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once per application.

    Functions run by ``mapInPandas`` / ``applyInPandas`` call into the package,
    so executors must import it. ``addPyFile`` hands Spark a zip of the package
    sources and Spark distributes it to every executor (on a cluster too), so
    nothing depends on the driver's working directory or an install step.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    # read by the driver only: addPyFile serves it to executors through Spark's
    # own file server, so no executor ever reads this driver-local folder
    path = os.path.join(tempfile.mkdtemp(prefix="tokenledger-pkg-"), "tokenledger.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_CHECKPOINTS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is read as is. Only
    when it is unset on a local master (local runs, tests) do we create a scratch
    folder: executors of a cluster would not share it, so there it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tokenledger-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if _CHECKPOINTS.get(sc.applicationId) != path:          # setting it makes a new sub-folder: once is enough
        sc.setCheckpointDir(path)
        _CHECKPOINTS[sc.applicationId] = path
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
