"""Reading the tables. All of them are parquet; a table is one file or a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered twice carry the same values: keep one row per key. Pre-aggregates before the shuffle."""
    return df.dropDuplicates([key])


def sha_text(col: str):
    return F.sha2(F.col(col).cast("binary"), 256)
