"""Directory trees and Parquet tables as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import language_of

#: Directories a walk leaves out.
EXCLUDED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache")


def walk(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",), excluded: tuple[str, ...] = EXCLUDED, most: int | None = None) -> DataFrame:
    """(path, size, last_modified, content_hash, git_hash, language, content) of the files below root."""
    # the glob prunes by name, so no other file's content is read; the folders go before the content is used
    glob = "{" + ",".join(f"*{s}" for s in suffixes) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^\\Q" + root.rstrip("/") + "/\\E", "")
    f = raw.withColumn("rel", base)
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("rel").endswith(s)
    f = f.filter(keep & ~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, excluded))))
    if most is not None:
        f = f.filter(F.col("length") <= most)
    head = F.encode(F.concat(F.lit("blob "), F.col("length").cast("string"), F.lit("\0")), "UTF-8")
    return f.select(F.col("rel").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.sha2("content", 256).alias("content_hash"), F.sha1(F.concat(head, "content")).alias("git_hash"), language_of("rel").alias("language"), F.col("content").cast("string").alias("content"))


def last_commit_per_path(commits_: DataFrame) -> DataFrame:
    """(path, sha, timestamp) of the newest commit that touched each path."""
    return commits_.select("sha", "timestamp", F.explode("files_changed").alias("path")).groupBy("path").agg(F.max_by("sha", F.struct("timestamp", "sha")).alias("sha"), F.max("timestamp").alias("timestamp"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table whose later joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
