"""What the sinks do to a table, as a DataFrame of the table afterwards. Writers live in codelode.sources.store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, the new one's values where both have the key; ``outcome`` says which it was. Keys are unique on each side."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    both = new.join(o, [new[k] == o[f"o_{k}"] for k in keys], "full")
    was, now = F.col(f"o_{keys[0]}").isNotNull(), new[keys[0]].isNotNull()
    cols = [F.when(now, new[c]).otherwise(F.col(f"o_{c}")).alias(c) for c in old.columns]
    return both.select(*cols, F.when(was & now, "updated").when(now, "created").otherwise("kept").alias("outcome"))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new to append."""
    return new.join(old.select(*keys), keys, "left_anti")


def bulk_update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the non-null values of new; rows of new without a match are ignored."""
    n = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys])
    got = old.join(n, keys, "left")
    return got.select(*[F.coalesce(f"n_{c}", c).alias(c) if f"n_{c}" in n.columns else F.col(c) for c in old.columns])


def cascade_delete(gone: DataFrame, chain: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """The rows that stay of each table of the chain, whose key column points to the table before it."""
    out, ids = [], gone.select("id").distinct()
    for df, key in chain:
        parent = ids.select(F.col("id").alias(key))
        out.append(df.join(parent, key, "left_anti"))
        ids = df.join(parent, key, "left_semi").select("id")
    return out


def soft_delete(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """is_deleted is whether the row's key was not seen again."""
    s = seen.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return df.drop("is_deleted").join(s, keys, "left").withColumn("is_deleted", F.col("_seen").isNull()).drop("_seen")


def merge_lists(df: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """One row per key; list columns become the sorted set of all their elements."""
    return df.groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], by: str) -> DataFrame:
    """keys and change (added, deleted, modified) between two snapshots; unchanged rows are left out."""
    o = old.select(*keys, F.col(by).alias("_o"), F.lit(True).alias("_was"))
    n = new.select(*keys, F.col(by).alias("_n"), F.lit(True).alias("_is"))
    return o.join(n, keys, "full").withColumn("change", F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")).filter("change is not null").select(*keys, "change")
