"""Windows over the event stream: batch plans and the same plans run as Structured Streaming to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.streaming import incremental as inc

from .base import Data, query


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stm9_tumbling(d: Data):
    return d.events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, count(*) AS n FROM events, unnest([0, 1]) AS t(k) GROUP BY 1")
def stm9_sliding(d: Data):
    return d.events.groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@query("SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, session")
def stm9_session(d: Data):
    return d.events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).select("user_id", "start", "last", "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stm9_stream_tumbling(d: Data):
    return inc.run_to_end(inc.daily_counts(inc.event_stream(d.spark, d.dir))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def stm3_high_water_marks(d: Data):
    return d.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("WITH w AS (SELECT repository_id, max(last_modified) - INTERVAL 30 DAY AS mark FROM files GROUP BY 1) SELECT f.repository_id, count(DISTINCT f.path) AS changed FROM files f JOIN w ON w.repository_id = f.repository_id WHERE f.last_modified >= w.mark GROUP BY 1", "files")
def stm4_changed_since_mark(d: Data):
    f = d.files.select("repository_id", "path", "last_modified")
    w = f.groupBy("repository_id").agg((F.max("last_modified") - F.make_dt_interval(F.lit(30))).alias("mark"))
    return f.join(w, "repository_id").filter(F.col("last_modified") >= F.col("mark")).select("repository_id", "path").distinct().groupBy("repository_id").agg(F.count("*").alias("changed"))


@query("SELECT repository_id, path, branch, max_by(id, (last_modified, id)) AS id FROM files WHERE last_modified IS NOT NULL GROUP BY 1, 2, 3", "files")
def stm6_idempotent_latest(d: Data):
    return inc.latest(d.raw("code_files").filter("last_modified is not null"), ["repository_id", "path", "branch"], "last_modified").select("repository_id", "path", "branch", "id")
