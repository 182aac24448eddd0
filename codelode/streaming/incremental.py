"""Incremental ingest with Structured Streaming: file streams, windowed counts, idempotent merges per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import shared_dir
from codelode.sources import store


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The table's files as a stream; event time as a timestamp in UTC, which watermarks need."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    folder = store.is_folder(spark, path)
    glob = path if folder else sf_dir
    reader = spark.readStream.schema(schema)
    if not folder:
        reader = reader.option("pathGlobFilter", f"{table}.parquet")
    return reader.parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_per_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Repeats of a key within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the stream over all input there is and returns the last result, written to the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key, the newest; what is delivered twice or late changes nothing."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(ts, *(["id"] if "id" in cols else []))).alias("r")).select(*keys, "r.*")


def merge_stream(stream: DataFrame, path: str, keys: list[str], ts: str, interval: str | None = None, then: Callable[[DataFrame], None] | None = None, parts: int = 16):
    """Keeps the newest row per key of a stream in a Parquet table; a batch that runs again gives the same table.

    Keys are spread over ``parts`` folders by hash. A batch rewrites the folders its keys fall into, under a name of its
    own for each attempt, and then moves the pointer to them in one step: readers see the table before or after it, and a
    run that breaks off anywhere leaves the table as it was.
    """

    def merge(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        now = pointer(spark, path)
        new = df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(now["parts"] if now else parts)).cast("int")).persist()
        touched = sorted(r[0] for r in new.select("_part").distinct().collect())
        old = [now["folders"][str(t)] for t in touched if now and str(t) in now["folders"]]
        both = new.unionByName(spark.read.parquet(*old).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(now["parts"])).cast("int"))) if old else new
        version = f"{path}/v{n}-{uuid.uuid4().hex}"
        latest(both, ["_part", *keys], ts).write.partitionBy("_part").parquet(version)
        new.unpersist()
        folders = (now["folders"] if now else {}) | {str(t): f"{version}/_part={t}" for t in touched}
        store.write_json(spark, f"{path}/pointer.json", {"parts": now["parts"] if now else parts, "folders": folders})
        if then is not None:
            then(current(spark, path))

    w = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").foreachBatch(merge)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What the table is made of; None before its first batch. A lost pointer beside versions is an error, not an empty table."""
    now = store.read_json(spark, f"{path}/pointer.json")
    if now is None and any(x.startswith("v") for x in store.children(spark, path)) and store.exists(spark, f"{path}/state/commits/0"):
        raise OSError(f"{path} has versions but no pointer")
    return now


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table a merge stream keeps, None before its first batch; one that can't be read is an error."""
    now = pointer(spark, path)
    return spark.read.parquet(*now["folders"].values()) if now and now["folders"] else None


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the version folders of which the table holds nothing any more; not while it is read or written."""
    now = pointer(spark, path)
    used = {f[len(path) + 1 :].split("/")[0] for f in now["folders"].values()} if now else set()
    gone = [x for x in store.children(spark, path) if x.startswith("v") and x not in used] if now else []
    for x in gone:
        store.remove(spark, f"{path}/{x}")
    return gone
