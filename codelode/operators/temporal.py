"""Joins that are not on equality alone: the latest row before a time, a value between two bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """Each row of left with ``take`` of the latest row of right whose keys are equal and whose ``at`` is not later.

    Both sides are one sorted stream per key, so no pairs are made; of right rows at the same time the largest ``take``
    counts. A null key or time finds nothing.
    """
    own = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.struct(*[F.col(c) for c in own]).alias("_own"), F.lit(None).cast(right.select(F.struct(*take).alias("x")).schema["x"].dataType).alias("_got"), F.lit(1).alias("_side"))
    b = right.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(F.struct(*take)).alias("_got")).select(*keys, at, F.lit(None).cast(a.schema["_own"].dataType).alias("_own"), "_got", F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(F.col(at).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = a.unionByName(b).withColumn("_got", F.last("_got", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*keys, at, *[F.col("_own")[c].alias(c) for c in own], *[F.when(known & F.col(at).isNotNull(), F.col("_got")[c]).alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs of a point and a range with lo <= value < hi, by an equi join on bins of ``width``.

    A range is copied once for each bin it touches: choose the width about as long as the ranges.
    """
    bin_of = lambda c: F.floor(c / F.lit(width))
    p = points.withColumn("_bin", bin_of(F.col(value)))
    r = ranges.filter(F.col(lo) < F.col(hi)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(lo)), bin_of(F.col(hi)))))
    return p.join(r, "_bin").filter((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("_bin")
