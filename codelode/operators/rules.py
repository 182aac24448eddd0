"""Rules over a domain model: each rule is a frame, their union is the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coupling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(context, entities, outgoing, score): relations to other contexts per entity of the context."""
    e = entities.groupBy("context").agg(F.count("*").alias("entities"))
    o = relations.filter("source <> target").groupBy(F.col("source").alias("context")).agg(F.count("*").alias("outgoing"))
    g = e.join(o, "context", "left").select("context", "entities", F.coalesce("outgoing", F.lit(0)).alias("outgoing"))
    return g.withColumn("score", F.round(F.col("outgoing") / F.greatest("entities", F.lit(1)), 2))


def pair_counts(relations: DataFrame) -> DataFrame:
    """(source, target, n, types) of the relations between different contexts."""
    return relations.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))


def _with_mean(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("mean", pairs.agg(F.avg("n")).scalar())


def advice(pairs: DataFrame, high: float = 1.2) -> DataFrame:
    strong = F.col("n") > high * F.col("mean")
    a = F.when(strong & F.array_contains("types", "R"), "orchestration").when(strong & F.array_contains("types", "A"), "dependency").when(strong, "strong").when(F.col("n") > F.col("mean"), "moderate").otherwise("acceptable")
    return _with_mean(pairs).select("source", "target", "n", a.alias("advice"))


def one_way(pairs: DataFrame, high: float = 1.2, low: float = 0.8) -> DataFrame:
    """Pairs strong in one direction and weak in the other."""
    back = pairs.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("n").alias("back"))
    p = _with_mean(pairs).join(back, ["source", "target"], "left")
    return p.filter((F.col("n") > high * F.col("mean")) & (F.coalesce("back", F.lit(0)) < low * F.col("mean"))).select("source", "target", "n")


def anti_patterns(classes: DataFrame, functions: DataFrame, god: int = 7) -> DataFrame:
    """(pattern, severity, id)."""
    n = functions.filter("class_id is not null").groupBy(F.col("class_id").alias("id")).agg(F.count("*").alias("methods"))
    x = classes.select("id", "docstring", F.coalesce(F.size("base_classes"), F.lit(0)).alias("bases")).join(n, "id", "left").withColumn("methods", F.coalesce("methods", F.lit(0)))
    found = F.array(
        F.when(F.col("methods") == 0, F.struct(F.lit("anemic").alias("pattern"), F.lit("medium").alias("severity"))),
        F.when(F.col("methods") > god, F.struct(F.lit("god_object").alias("pattern"), F.lit("high").alias("severity"))),
        F.when((F.col("bases") <= 0) & (F.col("methods") > 0) & F.col("docstring").isNull(), F.struct(F.lit("missing_root").alias("pattern"), F.lit("medium").alias("severity"))),
    )
    return x.select("id", F.explode(F.array_compact(found)).alias("f")).select("f.pattern", "f.severity", "id")


def health_a(pairs: DataFrame, high: float = 1.5) -> DataFrame:
    """100 less what the mean coupling and the number of strong pairs cost, between 0 and 100."""
    g = _with_mean(pairs).agg(F.avg("n").alias("coupling"), F.count_if(F.col("n") > high * F.col("mean")).alias("pairs"))
    cost = F.when(F.col("coupling") > 5, 30).when(F.col("coupling") > 3, 20).when(F.col("coupling") > 1, 10).otherwise(0)
    return g.select(F.round("coupling", 4).alias("coupling"), "pairs", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - cost - 3 * F.least("pairs", F.lit(10)))).cast("double").alias("health"))


def health_b(found: DataFrame) -> DataFrame:
    g = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    return g.withColumn("health", (100 - (10 * F.col("high") + 5 * F.col("medium"))).cast("long"))


def evolution(df: DataFrame, by: str, ts: str, as_of: str, days: int) -> DataFrame:
    """(by, total, added, growth) with what came in the last days before as_of."""
    since = F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    g = df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col(ts) >= since).alias("added"))
    return g.withColumn("growth", F.round(100.0 * F.col("added") / F.col("total"), 1))


def _smells(df: DataFrame, **rules) -> DataFrame:
    return df.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("smell"))


def function_smells(functions: DataFrame, good_name: Callable) -> DataFrame:
    return _smells(functions, long=F.col("end_line") - F.col("start_line") + 1 > 50, parameters=F.size("parameters") > 5, undocumented=F.col("docstring").isNull(), name=~good_name("name"))


def class_smells(classes: DataFrame, functions: DataFrame, good_name: Callable) -> DataFrame:
    n = functions.filter("class_id is not null").groupBy(F.col("class_id").alias("id")).agg(F.count("*").alias("methods"))
    return _smells(classes.join(n, "id", "left"), long=F.col("end_line") - F.col("start_line") + 1 > 200, methods=F.col("methods") > 20, undocumented=F.col("docstring").isNull(), name=~good_name("name"))


def mermaid(pairs: DataFrame, high: float = 1.2) -> DataFrame:
    """A context map's edges as text lines; the caller writes them below ``graph LR``."""
    return _with_mean(pairs).filter(F.col("n") > high * F.col("mean")).select(F.format_string("C%d -->|%d| C%d", "source", "n", "target").alias("line"))
