"""Session settings the operators rely on, and the folder that all machines of the cluster share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the virtual machine compiles no method above this size; plans with many long expressions would run interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # packed boxes grow some thirtyfold in memory: a task that sorts a split of the default 128 MB would spill most of it
    "spark.sql.files.maxPartitionBytes": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _broadcast_by_measure(spark)
    return spark


def _broadcast_by_measure(spark: SparkSession) -> None:
    """The session's limit for broadcasts holds for bytes that a shuffle has measured, no longer for the planner's guess from file sizes: columns
    of stored results compress a hundredfold, so that a file of 10 MB may fill the driver. F.broadcast still marks sides that are bounded."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(planned)
    if limit not in ("-1", "-1b"):
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, limit)
        spark.conf.set(planned, "-1")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state of streams started inside lies in RocksDB; the session's own setting comes back after that."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they find it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="cartonscope-")), "cartonscope.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset a single machine gets a folder of its own;
    on a cluster that is an error, since its machines would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="cartonscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
