"""Session factory and the settings every operator may rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("codelode")
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers if they can't import it by themselves: once per application, from the driver."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if getattr(sc, "_codelode_shipped", False) or os.path.isfile(root):
        return
    sc._codelode_shipped = True
    if root in {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}:
        return
    at = os.path.join(tempfile.mkdtemp(prefix="codelode-"), "codelode.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a temporary one on a local master; on a cluster that would be a folder of the driver, an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            at = got.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            at = tempfile.mkdtemp(prefix="codelode-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at
