"""Files and folders through the Hadoop file system, so that paths may be local or remote."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def children(spark: SparkSession, path: str) -> list[str]:
    fs, at, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, at, jvm = _fs(spark, source)
    if not fs.rename(at, jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def read_json(spark: SparkSession, path: str):
    """The file's content, None if there is no such file; one that can't be read is an error."""
    fs, at, jvm = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Writes the file aside and moves it over the old one in one step, so a reader sees the old or the new content."""
    fs, _, jvm = _fs(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(jvm.org.apache.hadoop.fs.Path(aside))
    out.write(json.dumps(value).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path), options)


def replace(df: DataFrame, path: str) -> DataFrame:
    """Writes a table that df may read from: to a new folder, which then takes the old one's place. The old one is only
    removed when the new one is there; if that fails in between, the old one stands beside as ``path.old-...``."""
    spark, path = df.sparkSession, path.rstrip("/")
    mark = uuid.uuid4().hex
    df.write.parquet(f"{path}.new-{mark}")
    if exists(spark, path):
        move(spark, path, f"{path}.old-{mark}")
    try:
        move(spark, f"{path}.new-{mark}", path)
    except Exception:
        if exists(spark, f"{path}.old-{mark}"):
            move(spark, f"{path}.old-{mark}", path)
        raise
    remove(spark, f"{path}.old-{mark}")
    return spark.read.parquet(path)
