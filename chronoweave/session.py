"""Spark session settings that the engine relies on."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import SparkSession

_folders: dict[str, object] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; in local mode without that setting, in the
    machine's temporary folder. It goes when the program ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = f"file://{tempfile.gettempdir()}"
    out = f"{at}/{name}-{uuid.uuid4().hex}"
    _folders[out] = spark._jsparkSession.sessionState().newHadoopConf()
    return out


@atexit.register
def _clean() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone before us
        while _folders and SparkContext._jvm is not None:
            at, conf = _folders.popitem()
            path = SparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC time, adaptive execution with skew-join splitting, no UI. On a cluster leave master to spark-submit."""
    b = SparkSession.builder.appName("chronoweave")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()
